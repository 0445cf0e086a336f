"""Token counts of documents in flat token files: no index, only identifiers with an end-of-document one after each.

A file is cut into blocks; each block is searched for separators in one vectorised comparison. What a block can't
know by itself, how many documents ended before it and where its first one began, comes from a prefix scan over the
blocks' summaries in two levels (within spans of blocks, then over the spans), which stitches documents over borders.
"""

from __future__ import annotations

import base64
import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import file_system, fresh, raw_texts, scratch, written

#: Tokens of a block; blocks of a span; bytes after which a new file begins.
BLOCK, SPAN, FILE_BYTES = 1 << 20, 1024, 64 << 20
#: Vocabulary file, identifier that ends a document.
VOCABULARY, SEPARATOR = "byte_bpe_50k.tiktoken", 50256


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@functools.lru_cache(maxsize=2)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_tokens(docs: DataFrame, folder: str | None = None, path: str | None = None, separator: int = SEPARATOR, text: str = "text", width: int = 2) -> DataFrame:
    """Write the texts of docs as token files below folder (one of the shared scratch by default).

    Gives a row for each row of docs: its columns other than text, and file, nth (its place in the file), file_bytes.
    The identifiers are unsigned little-endian of width bytes. A null text is an empty one: its separator alone. File
    names are new in every attempt; only those in the table given back count.
    """
    folder, path = folder or scratch(docs.sparkSession, "tokens"), path or default_path()
    kept = [c for c in docs.columns if c.lower() not in (text.lower(), "file", "nth", "file_bytes")]
    given = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).cast("string").alias(fresh(kept, "whole_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoding(path).encode_ordinary, np.array([separator], f"<u{width}").tobytes()
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        out, name, size, nth = None, "", 0, 0
        try:
            for batch in batches:
                at, files, places = batch.num_columns - 1, [], []
                for raw in raw_texts(batch.column(at)):
                    if out is None or size >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, size, nth = f"{folder}/{uuid.uuid4().hex}.tokens", 0, 0
                        out = fs.open_output_stream(f"{base}/{name.rsplit('/', 1)[1]}", compression=None)
                    data = np.array(encode(raw.decode("utf-8", "replace")), f"<u{width}").tobytes() + end
                    out.write(data)
                    files.append(name)
                    places.append(nth)
                    nth, size = nth + 1, size + len(data)
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(files, pa.string()), pa.array(places, pa.int64())], [*batch.schema.names[:at], "file", "nth"])
        finally:
            if out is not None:
                out.close()

    schema = given.drop(given.columns[-1]).schema.add("file", "string").add("nth", "long")
    return written(given.mapInArrow(run, schema), "places")


def sizes(files: DataFrame) -> DataFrame:
    """(file, file_bytes) for the distinct files named in column file."""

    @F.arrow_udf("long")
    def measure(names: pa.Array) -> pa.Array:
        found = []
        for name in names.to_pylist():
            fs, path = file_system(name)
            found.append(fs.get_file_info(path).size)
        return pa.array(found, pa.int64())

    return files.select("file").distinct().withColumn("file_bytes", measure("file"))


def separators(files: DataFrame, separator: int = SEPARATOR, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, block, n_tokens, ends array<int>) for each block of the files (file, file_bytes): where separators stand in it."""
    step = block * width
    cut = F.sequence(F.lit(0).cast("long"), F.floor((F.col("file_bytes") - 1) / step))
    blocks = files.filter("file_bytes > 0").select("file", "file_bytes", F.explode(cut).alias("block"))
    count = files.agg(F.sum(F.ceil(F.col("file_bytes") / step))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size, number in zip(*(c.to_pylist() for c in batch.columns)):
                if size % width:
                    raise ValueError(f"{name}: {size} bytes are no whole number of identifiers")
                fs, path = file_system(name)
                with fs.open_input_file(path) as file:
                    data = file.read_at(min(step, size - number * step), number * step)
                if len(data) != min(step, size - number * step):
                    raise ValueError(f"{name}: cut off in block {number}")
                found = np.frombuffer(data, f"<u{width}")
                ends = np.flatnonzero(found == separator).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([number], pa.int64()), pa.array([len(found)], pa.int64()), pa.array([ends], pa.list_(pa.int32()))], ["file", "block", "n_tokens", "ends"])

    dealt = blocks.repartition(max(1, min(int(count), 100_000)))
    return dealt.mapInArrow(run, "file string, block long, n_tokens long, ends array<int>")


def documents(files: DataFrame, separator: int = SEPARATOR, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, nth, start, n_tokens, ended) for each document of the files (file, file_bytes).

    start counts tokens from the file's begin; n_tokens leaves out the separator. What stands after the last
    separator is a document too (ended: false), if there is any. Two separators in a row hold an empty document
    between them. An empty file has no documents. No block or span is gathered: a file of any length is read in
    blocks, and the scan holds a row a block, then a row a span.
    """
    found = written(separators(files, separator, width, block), "blocks").withColumn("span", F.floor(F.col("block") / SPAN))
    base = F.col("block") * block
    last = F.when(F.size("ends") > 0, base + F.element_at("ends", -1) + 1)
    within = Window.partitionBy("file", "span").orderBy("block")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    spans = found.groupBy("file", "span").agg(F.sum(F.size("ends")).alias("n"), F.max(last).alias("last"), F.max("block").alias("final"))
    over = Window.partitionBy("file").orderBy("span")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(
        "file", "span", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"), F.coalesce(F.max("last").over(earlier), F.lit(0)).alias("last_before"),
        (F.max("final").over(Window.partitionBy("file"))).alias("final"),
    )
    scanned = found.select(
        "file", "span", "block", "n_tokens", "ends", base.alias("base"),
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("n_here"), F.max(last).over(before).alias("last_here"),
    ).join(carried, ["file", "span"])
    known = scanned.select("file", "block", "base", "n_tokens", "ends", "final", (F.col("n_here") + F.col("n_before")).alias("first"), F.coalesce("last_here", "last_before").alias("open"))
    at = F.transform("ends", lambda e: e.cast("long") + F.col("base"))
    starts = F.concat(F.array("open"), F.transform(at, lambda e: e + 1))
    stop = F.col("base") + F.col("n_tokens")
    tail = (F.col("block") == F.col("final")) & (F.element_at(starts, -1) < stop)
    ends = F.when(tail, F.concat(at, F.array(stop))).otherwise(at)
    pairs = F.zip_with(F.slice(starts, 1, F.size(ends)), ends, lambda s, e: F.struct(s.alias("start"), e.alias("end")))
    rows = known.select("file", "first", F.size("ends").alias("n_ends"), F.posexplode(pairs).alias("i", "d"))
    return rows.select("file", (F.col("first") + F.col("i")).alias("nth"), "d.start", (F.col("d.end") - F.col("d.start")).alias("n_tokens"), (F.col("i") < F.col("n_ends")).alias("ended"))


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, file, nth, start, n_tokens) of each row of docs, counted in the files that its text was written to.

    A null or empty text has 0 tokens; repeated rows are counted each; an empty table gives no rows.
    """
    places = write_tokens(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), **options)
    width, separator = options.get("width", 2), options.get("separator", SEPARATOR)
    counted = documents(written(sizes(places), "files"), separator, width)
    return places.join(counted, ["file", "nth"]).select("doc_id", "file", "nth", "start", "n_tokens")
