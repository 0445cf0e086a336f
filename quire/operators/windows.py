"""Order-dependent rows: runs, clusters, numbering, paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.sampling import numbered


def islands(df: DataFrame, by: str, order: str, same: Column, name: str = "run") -> DataFrame:
    """Numbers the runs of rows for which same (of a row and, by lag, the one before) holds."""
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumn(name, F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w))


def lagged(column: str | Column, by: str, order: str) -> Column:
    return F.lag(column).over(Window.partitionBy(by).orderBy(order))


def sliding_median(df: DataFrame, by: str, order: str, value: str, n: int, size: int = 4096) -> DataFrame:
    """The median of each row and the n - 1 before it in its group. Groups are cut into stretches of size rows, each with the last rows of the one before."""
    placed = numbered(df, [by], [order], "__p").withColumn("__cut", F.floor((F.col("__p") - 1) / size))
    also = F.when((F.col("__p") - 1) % size >= size - n + 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = placed.withColumn("__halo", F.explode(also)).withColumn("__cut", F.col("__cut") + F.col("__halo"))
    w = Window.partitionBy(by, "__cut").orderBy("__p").rowsBetween(1 - n, 0)
    return rows.withColumn("median", F.round(F.percentile(value, 0.5).over(w), 6)).filter("__halo = 0").drop("__p", "__cut", "__halo")


def typographic_runs(df: DataFrame, by: str, order: str, keys: list[str], text: str) -> DataFrame:
    """Neighbours with equal keys as one run, texts joined in order."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(lagged(k, by, order)) & lagged(F.lit(1), by, order).isNotNull()
    runs = islands(df, by, order, same)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), "")
    return runs.groupBy(by, "run", *keys).agg(F.count("*").alias("n"), joined.alias("text"))


def fold_markers(df: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """Runs of up to two characters without a letter or digit join the next one that is none; the last ones join the last."""
    w = Window.partitionBy(by).orderBy(order)
    real = F.when(~((F.length(text) <= 2) & ~F.col(text).rlike(r"[\p{L}\p{N}]")), F.col(order))
    ahead = F.first(real, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    last = F.max(real).over(Window.partitionBy(by))
    marked = df.withColumn("home", F.coalesce(ahead, last, F.min(order).over(Window.partitionBy(by))))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), "")
    return marked.groupBy(by, "home").agg(joined.alias("text"), F.count("*").alias("n"))


def merge_headers(df: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """A line of digits alone and one after it that begins with ) become one."""
    w = Window.partitionBy(by).orderBy(order)
    digits = lambda c: c.rlike(r"^[0-9]+$")
    after, before, here = F.lead(text).over(w), F.lag(text).over(w), F.col(text)
    takes = digits(here) & F.coalesce(after.startswith(")"), F.lit(False))
    taken = F.coalesce(digits(before), F.lit(False)) & here.startswith(")")
    return df.withColumn("__taken", taken).withColumn("merged", F.when(takes, F.concat(here, after)).otherwise(here)).filter(~F.col("__taken")).drop("__taken")


def paragraphs(lines: DataFrame, by: str, order: str, x0: str, x1: str, y0: str, y1: str, text: str) -> DataFrame:
    """Lines joined to the paragraph of a region; a new one begins after a line that doesn't reach the end (its own height short of the region's width)."""
    width = F.max(x1).over(Window.partitionBy(by)) - F.min(x0).over(Window.partitionBy(by))
    full = (F.col(x1) - F.col(x0)) >= width - (F.col(y1) - F.col(y0))
    marked = islands(lines.withColumn("__full", full), by, order, lagged("__full", by, order), "paragraph").drop("__full")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), " ")
    return marked.groupBy(by, "paragraph").agg(F.count("*").alias("n"), joined.alias("text"))


def cluster_values(df: DataFrame, by: str, value: str, tolerance: float) -> DataFrame:
    """Values no further than tolerance from the one before are a cluster; its centre is their mean."""
    marked = islands(df.select(by, value), by, value, F.col(value) - lagged(value, by, value) <= tolerance, "cluster")
    return marked.groupBy(by, "cluster").agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("centre"))


def list_numbers(df: DataFrame, by: str, order: str, level: str) -> DataFrame:
    """The number of each list row (level not null) among those of its level since the last row that is none."""
    w = Window.partitionBy(by).orderBy(order)
    marked = df.withColumn("__stretch", F.sum(F.col(level).isNull().cast("int")).over(w))
    number = F.row_number().over(Window.partitionBy(by, "__stretch", level).orderBy(order))
    return marked.withColumn("number", F.when(F.col(level).isNotNull(), number)).drop("__stretch")


def grouped_parts(df: DataFrame, by: str, order: str, kind: str, text: str) -> DataFrame:
    """Texts of neighbours of one kind joined by line ends, kinds by blank lines: one text a group."""
    runs = islands(df, by, order, F.col(kind) == lagged(kind, by, order))
    ordered = lambda key, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "t"))), lambda s: s["t"]), sep)
    parts = runs.withColumn("t", F.col(text)).groupBy(by, "run").agg(ordered(order, "\n").alias("t"))
    return parts.groupBy(by).agg(F.count("*").alias("n_parts"), ordered("run", "\n\n").alias("text"))


def concat_pages(df: DataFrame, by: str, order: str, text: str, separator: str = "\n\f") -> DataFrame:
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.coalesce(text, F.lit("")).alias("t")))), lambda s: s["t"]), separator)
    return df.groupBy(by).agg(F.count("*").alias("n_pages"), joined.alias("page_content"))
