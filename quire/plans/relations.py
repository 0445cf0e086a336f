"""Test relations of document geometry and text, derived from the given tables, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Orders of a page, so that pages are of bounded size however many there are; its width and height; characters of a piece.
ORDERS, WIDE, HIGH, PIECE = 16, 900, 1200, 200

#: The same relations for the oracle, to stand after WITH.
SQL = {
    "boxes": """boxes AS (SELECT l_orderkey // 16 AS page_id, l_orderkey * 8 + l_linenumber AS box_id,
        CAST(min(l_partkey) % 900 AS DOUBLE) AS x0, CAST(min(l_suppkey) * 7 % 1200 AS DOUBLE) AS y0,
        CAST(min(l_partkey) % 900 AS DOUBLE) + 10 + min(l_quantity) AS x1, CAST(min(l_suppkey) * 7 % 1200 AS DOUBLE) + 8 + round(min(l_discount) * 100) AS y1,
        1 - round(min(l_tax) * 100) * 5 / 100 AS score, min(l_returnflag) AS label, 't' || CAST(min(l_partkey) AS VARCHAR) AS text
        FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
    "cells": """cells AS (SELECT CAST(p.i AS BIGINT) AS page_id, CAST(r.i * 5 + c.i AS BIGINT) AS box_id, CAST(c.i * 180 AS DOUBLE) AS x0, CAST(r.i * 150 AS DOUBLE) AS y0,
        CAST(c.i * 180 + 180 AS DOUBLE) AS x1, CAST(r.i * 150 + 150 AS DOUBLE) AS y1 FROM (SELECT DISTINCT l_orderkey // 16 AS i FROM lineitem) p, range(8) r(i), range(5) c(i))""",
    "pred": """pred AS (SELECT page_id, box_id, x0 + box_id % 7 AS x0, y0 + box_id % 5 AS y0, x1 + box_id % 7 AS x1, y1 + box_id % 5 AS y1, score,
        CASE WHEN box_id % 6 = 0 THEN 'X' ELSE label END AS label, text FROM boxes)""",
    "lines": """lines AS (SELECT doc_id, CAST(pos AS BIGINT) AS line_no, parts[pos + 1] AS line FROM
        (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents))""",
    "pairs": """pairs AS (SELECT doc_id, lang, piece, target, CASE WHEN doc_id % 3 = 0 THEN translate(target, 'lO', '10') ELSE target END AS found FROM
        (SELECT doc_id, lang, beg // 200 AS piece, substring(text, CAST(beg + 1 AS BIGINT), 200) AS target FROM (SELECT *, unnest(range(0, length(text), 200)) AS beg FROM documents)))""",
    "bits": """bits AS (SELECT doc_id, line_no, beg // n AS piece, substring(line, CAST(beg + 1 AS BIGINT), n) AS bit FROM
        (SELECT *, 10 + doc_id % 30 AS n, unnest(range(0, length(line), 10 + doc_id % 30)) AS beg FROM lines))""",
}
INTER = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0.0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0.0)"
AREA_A, AREA_B = "((a.x1 - a.x0) * (a.y1 - a.y0))", "((b.x1 - b.x0) * (b.y1 - b.y0))"
IOU = f"({INTER}) / ({AREA_A} + {AREA_B} - {INTER})"
#: Area of the convex hull of both: the box around them less a triangle at each corner that neither fills alone.
HULL_AREA = """((greatest(a.x1, b.x1) - least(a.x0, b.x0)) * (greatest(a.y1, b.y1) - least(a.y0, b.y0)) - (greatest(-(a.x0 - b.x0) * (a.y0 - b.y0), 0.0) + greatest(-(a.x1 - b.x1) * (a.y1 - b.y1), 0.0)
    + greatest((a.x0 - b.x0) * (a.y1 - b.y1), 0.0) + greatest((a.x1 - b.x1) * (a.y0 - b.y0), 0.0)) / 2)"""
HULL = f"({INTER}) / {HULL_AREA}"
TOUCH = "a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1"
CENTRE = "(b.x0 + b.x1) / 2 BETWEEN a.x0 AND a.x1 AND (b.y0 + b.y1) / 2 BETWEEN a.y0 AND a.y1"


def with_sql(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"


def fold_sql(relations: tuple[str, ...], rows: str, order: str, step: str, kind: str, out: str, by: str = "page_id") -> str:
    """SQL that folds the rows of each group in an order: step makes of the list a.acc (of kind) and a row b the next one; out reads the last list l.acc.

    The second step in every group sees what the first one made, so lists grow as a kernel's do.
    """
    same = " AND ".join(f"b.{c} = a.{c}" for c in by.split(", "))
    keys = ", ".join(f"b.{c}" for c in by.split(", "))
    return with_sql(*relations).replace("WITH ", "WITH RECURSIVE ", 1) + f""", rows AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS k, count(*) OVER (PARTITION BY {by}) AS n FROM ({rows})),
fold AS (SELECT {by}, CAST(0 AS BIGINT) AS k, max(n) AS n, CAST([] AS {kind}) AS acc FROM rows GROUP BY {by} UNION ALL SELECT {keys}, b.k, b.n, CAST({step} AS {kind}) FROM fold a JOIN rows b ON {same} AND b.k = a.k + 1)
SELECT {out} FROM (SELECT {by}, acc FROM fold WHERE k = n) l"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    least = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag")])
    x, y = (F.col("l_partkey") % WIDE).cast("double"), (F.col("l_suppkey") * 7 % HIGH).cast("double")
    return least.select(
        F.floor(F.col("l_orderkey") / ORDERS).alias("page_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("box_id"), x.alias("x0"), y.alias("y0"), (x + 10 + F.col("l_quantity")).alias("x1"),
        (y + 8 + F.round(F.col("l_discount") * 100)).alias("y1"), (1 - F.round(F.col("l_tax") * 100) * 5 / 100).alias("score"), F.col("l_returnflag").alias("label"), F.concat(F.lit("t"), F.col("l_partkey").cast("string")).alias("text"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = F.explode(F.sequence(F.lit(0), F.lit(39)))
    rows = read(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / ORDERS).alias("page_id")).distinct().select("page_id", grid.alias("box_id")).withColumn("box_id", F.col("box_id").cast("long"))
    x, y = (F.col("box_id") % 5 * 180).cast("double"), (F.floor(F.col("box_id") / 5) * 150).cast("double")
    return rows.select("page_id", "box_id", x.alias("x0"), y.alias("y0"), (x + 180).alias("x1"), (y + 150).alias("y1"))


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    right, down = F.col("box_id") % 7, F.col("box_id") % 5
    label = F.when(F.col("box_id") % 6 == 0, "X").otherwise(F.col("label"))
    return boxes(spark, sf_dir).withColumns({"x0": F.col("x0") + right, "y0": F.col("y0") + down, "x1": F.col("x1") + right, "y1": F.col("y1") + down, "label": label})


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def pieces(text: str, size: Column) -> Column:
    """(piece, its text): the consecutive pieces of size characters that a text consists of; none of an empty one."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, size))
    return F.posexplode(F.transform(starts, lambda i: F.substring(F.col(text), i + 1, size)))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of whole texts, as recognised lines are short, and misread ones."""
    cut = read(spark, sf_dir, "documents").select("doc_id", "lang", pieces("text", F.lit(PIECE)).alias("piece", "target")).withColumn("piece", F.col("piece").cast("long"))
    return cut.withColumn("found", F.when(F.col("doc_id") % 3 == 0, F.translate("target", "lO", "10")).otherwise(F.col("target")))


def bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of 10 to 39 characters that whole lines consist of."""
    size = (10 + F.col("doc_id") % 30).cast("int")
    return lines(spark, sf_dir).select("doc_id", "line_no", pieces("line", size).alias("piece", "bit")).withColumn("piece", F.col("piece").cast("long"))


def misread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts and misread ones."""
    return read(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").alias("target"), F.when(F.col("doc_id") % 3 == 0, F.translate("text", "lO", "10")).otherwise(F.col("text")).alias("found"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags and texts of web pages, in order: (page_id, place, type, text)."""
    found = F.regexp_extract_all("html", F.lit(r"(?s)<(h1|p|footer|nav)>(.*?)(?=</?(?:h1|p|footer|nav|article)>)"), 0)
    one = read(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("place", "raw"))
    tag = F.regexp_extract("raw", r"^<(h1|p|footer|nav)>", 1)
    kind = F.when(tag == "h1", "title").when(tag == "footer", "footer").when(tag == "nav", "header").otherwise("text")
    return one.select("page_id", F.col("place").cast("long").alias("place"), kind.alias("type"), F.trim(F.regexp_replace(F.regexp_replace("raw", "<[^>]*>", " "), r"\s+", " ")).alias("text"))
