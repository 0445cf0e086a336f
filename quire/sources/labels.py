"""Label files, result JSON and inputs as typed DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "array<array<double>>"
DETECTION = f"array<struct<transcription:string,points:{POINTS}>>"
TABLE = "filename string, html struct<cells:array<struct<tokens:array<string>,bbox:array<int>>>,structure:struct<tokens:array<string>>>"
OCR_PAGES = "struct<result:struct<dataInfo:map<string,string>,ocrResults:array<struct<prunedResult:struct<rec_texts:array<string>,rec_scores:array<double>,rec_boxes:array<array<int>>>,ocrImage:string,docPreprocessingImage:string,inputImage:string>>>>"
DOC_PAGES = "struct<result:struct<dataInfo:map<string,string>,layoutParsingResults:array<struct<prunedResult:string,markdown:struct<text:string,images:map<string,string>,isStart:boolean>,outputImages:map<string,string>,inputImage:string,exports:map<string,string>>>>>"
STATES = ("pending", "running", "done", "failed")
IMAGES = ("jpg", "bmp", "png", "jpeg", "rgb", "tif", "tiff", "gif", "pdf")


def label_lines(spark: SparkSession, paths: str | list[str], delimiter: str = "\t", sizes: bool = False) -> DataFrame:
    """(file, path, label) of each line, with w and h if the lines have them."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.split("value", delimiter).alias("p"))
    out = lines.select("file", F.get("p", F.lit(0)).alias("path"), F.get("p", F.lit(1)).alias("label"), "p")
    if sizes:
        out = out.withColumns({"w": F.get("p", F.lit(2)).cast("double"), "h": F.get("p", F.lit(3)).cast("double")})
    return out.drop("p")


def one_path(path: Column, key: Column, seed: int = 0) -> Column:
    """Of a JSON list of paths one, by a draw of the key; other paths as they are."""
    many = F.from_json(path, "array<string>")
    return F.when(path.startswith("[") & (F.size(many) > 0), F.element_at(many, (F.pmod(F.xxhash64(F.lit(seed), key), F.size(many)) + 1).cast("int"))).otherwise(path)


def detection_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """df with boxes (points, text, ignored) of its JSON; rows without boxes go. Texts of * or ### and polygons with NaN are ignored ones."""
    parsed = F.from_json(label, DETECTION)
    ignored = lambda b: b["transcription"].isin("*", "###") | F.exists(F.flatten(b["points"]), F.isnan)
    boxes = F.transform(parsed, lambda b: F.struct(b["points"].alias("points"), b["transcription"].alias("text"), ignored(b).alias("ignored")))
    return df.withColumn("boxes", boxes).filter(F.size("boxes") > 0)


def table_labels(spark: SparkSession, paths: str | list[str], longest: int = 500) -> DataFrame:
    return spark.read.schema(TABLE).json(paths).filter(F.size("html.structure.tokens").between(1, longest))


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of image kinds by path, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)).alias("kind")).filter(F.col("kind").isin(*IMAGES)).orderBy("path")


def pages_of(lines: DataFrame, column: str = "value", kind: str = "ocr") -> DataFrame:
    """A row a page of result lines in JSON; blank lines go, lines that don't parse or lack the results fail the check column."""
    field = "ocrResults" if kind == "ocr" else "layoutParsingResults"
    parsed = lines.filter(F.trim(column) != "").withColumn("r", F.from_json(F.trim(column), OCR_PAGES if kind == "ocr" else DOC_PAGES))
    pages = parsed.select("*", F.posexplode_outer(f"r.result.{field}").alias("page_index", "page"))
    return pages.withColumn("valid", F.col(f"r.result.{field}").isNotNull()).drop("r")


def page_summary(pages: DataFrame, by: list[str]) -> DataFrame:
    """Texts without blank ones joined by line ends, and the mean of their scores; a missing score is 0."""
    lines = F.filter(F.arrays_zip(F.col("page.prunedResult.rec_texts").alias("t"), F.col("page.prunedResult.rec_scores").alias("s")), lambda x: F.trim(x["t"]) != "")
    total = F.aggregate("lines", F.lit(0.0), lambda a, x: a + F.coalesce(x["s"], F.lit(0.0)))
    return pages.withColumn("lines", lines).select(*by, F.array_join(F.transform("lines", lambda x: F.trim(x["t"])), "\n").alias("text"), F.when(F.size("lines") > 0, total / F.size("lines")).otherwise(F.lit(0.0)).alias("confidence"), F.size("lines").alias("n_lines"))


def envelope(column: Column) -> Column:
    """What is wrong with a job's answer in JSON, or null: code, data, jobId, state, resultUrl."""
    get = lambda p: F.get_json_object(column, p)
    return (
        F.when(get("$").isNull(), "not json").when(get("$.data").isNull(), "no data").when(F.coalesce(get("$.code"), F.lit("0")) != "0", F.concat(F.lit("code "), get("$.code")))
        .when(get("$.data.jobId").isNull(), "no jobId").when(~F.coalesce(get("$.data.state"), F.lit("")).isin(*STATES), "unknown state")
        .when((get("$.data.state") == "done") & get("$.data.resultUrl.jsonUrl").isNull(), "no resultUrl")
    )


def input_kind(value: Column) -> Column:
    """url, data-url, base64, path or relative: the first that fits."""
    return (
        F.when(F.lower(value).rlike(r"^https?://"), "url").when(value.rlike(r"^data:[^,]*;base64,"), "data-url")
        .when(value.rlike(r"^(?:[A-Za-z0-9+/]{4})+(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$") & (F.length(value) >= 16), "base64")
        .when(value.startswith("/"), "path").otherwise("relative")
    )


def magic(data: Column) -> Column:
    """pdf, png, jpeg, gif, bmp or tiff by a file's first bytes; null for others."""
    head = F.hex(F.substring(data, 1, 8))
    out = F.lit(None).cast("string")
    for start, kind in (("25504446", "pdf"), ("89504E47", "png"), ("FFD8FF", "jpeg"), ("47494638", "gif"), ("424D", "bmp"), ("49492A00", "tiff"), ("4D4D002A", "tiff")):
        out = F.when(head.startswith(start), kind).otherwise(out)
    return out


def form_links(entities: DataFrame, by: str) -> DataFrame:
    """Distinct links (head, tail) of entities (id, label, linking) whose ends have text, questions before answers, by head."""
    links = entities.select(by, F.explode("linking").alias("l")).select(by, F.array_sort("l").alias("l")).distinct().select(by, F.col("l")[0].alias("a"), F.col("l")[1].alias("b"))
    ends = entities.filter(F.trim("text") != "").select(by, "id", "label")
    both = links.join(ends.toDF(by, "a", "la"), [by, "a"]).join(ends.toDF(by, "b", "lb"), [by, "b"])
    turned = (F.col("la") == "answer") & (F.col("lb") == "question")
    return both.select(by, F.when(turned, F.col("b")).otherwise(F.col("a")).alias("head"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("tail"))
