"""Metrics as aggregates: sums and counts that combine before the shuffle, divided at the end."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import alnum_lower

EPS = 1e-5


def recognition(df: DataFrame, by: list[str], target: str, found: str, plain: bool = True, spaces: bool = False) -> DataFrame:
    """n, matches, acc and 1 - mean normalised edit distance of found against target; both empty count as no distance."""
    side = lambda c: alnum_lower(F.col(c)) if plain else F.col(c) if spaces else F.replace(F.col(c), F.lit(" "), F.lit(""))
    pairs = df.select(*by, side(target).alias("a"), side(found).alias("b"))
    longest = F.greatest(F.length("a"), F.length("b"))
    far = F.when(longest > 0, F.levenshtein("a", "b") / longest).otherwise(F.lit(0.0))
    sums = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.sum((F.col("a") == F.col("b")).cast("long")).alias("matches"), F.sum(far).alias("d"))
    return sums.select(*by, "n", "matches", F.round(F.col("matches") / (F.col("n") + EPS), 6).alias("acc"), F.round(1 - F.col("d") / (F.col("n") + EPS), 6).alias("norm_edit_dis"))


def accuracy(df: DataFrame, by: list[str], truth: str, found: str) -> DataFrame:
    sums = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum((F.col(truth) == F.col(found)).cast("long")).alias("correct"))
    return sums.withColumn("acc", F.round(F.col("correct") / (F.col("n") + EPS), 6))


def f_measure(tp: Column, n_found: Column, n_truth: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and their harmonic mean; zero where nothing is there."""
    p = F.when(n_found > 0, tp / n_found).otherwise(F.lit(0.0))
    r = F.when(n_truth > 0, tp / n_truth).otherwise(F.lit(0.0))
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def detection(counts: DataFrame, by: list[str]) -> DataFrame:
    """Micro precision, recall and hmean of per-page counts (matched, det_care, gt_care)."""
    sums = counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("matched", "det_care", "gt_care")])
    p, r, h = f_measure(F.col("matched"), F.col("det_care"), F.col("gt_care"))
    return sums.select(*by, "matched", "det_care", "gt_care", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(h, 6).alias("hmean"))


def node_f1(pairs: DataFrame, truth: str, found: str, ignored: list[int]) -> DataFrame:
    """F1 of each class that isn't ignored, from one count a (truth, found); empty classes divide by one."""
    counts = pairs.groupBy(F.col(truth).alias("t"), F.col(found).alias("f")).agg(F.count("*").alias("c"))
    sides = counts.select(F.explode(F.array(
        F.struct(F.col("t").alias("label"), F.col("c").alias("truth"), F.lit(0).cast("long").alias("found"), F.when(F.col("t") == F.col("f"), F.col("c")).otherwise(0).alias("hit")),
        F.struct(F.col("f").alias("label"), F.lit(0).cast("long").alias("truth"), F.col("c").alias("found"), F.lit(0).cast("long").alias("hit")))).alias("s"))
    sums = sides.groupBy("s.label").agg(F.sum("s.truth").alias("n_truth"), F.sum("s.found").alias("n_found"), F.sum("s.hit").alias("hit")).filter(~F.col("label").isin(ignored))
    return sums.withColumn("f1", F.round(2 * F.col("hit") / F.greatest(F.col("n_truth") + F.col("n_found"), F.lit(1)), 6))


def entity_spans(tokens: DataFrame, doc: str, place: str, tag: str) -> DataFrame:
    """(doc, label, first, last) of BIO tags: a span begins at B-, or where I- follows another label."""
    w = Window.partitionBy(doc).orderBy(place)
    kind, label = F.substring(tag, 1, 1), F.expr(f"substring({tag}, 3)")
    before = F.lag(F.when(F.col(tag) == "O", F.lit("")).otherwise(label), 1, "").over(w)
    begins = (F.col(tag) != "O") & ((kind == "B") | (before != label))
    marked = tokens.select(doc, place, F.col(tag), label.alias("label"), F.sum(begins.cast("int")).over(w).alias("span"))
    return marked.filter(F.col(tag) != "O").groupBy(doc, "span", "label").agg(F.min(place).alias("first"), F.max(place).alias("last")).drop("span")


def set_f1(truth: DataFrame, found: DataFrame, doc: str, by: list[str]) -> DataFrame:
    """TP, FP, FN and F1 a document over distinct rows."""
    a = truth.select(doc, *by).distinct().withColumn("__t", F.lit(1))
    b = found.select(doc, *by).distinct().withColumn("__f", F.lit(1))
    both = a.join(b, [doc, *by], "full").groupBy(doc).agg(
        F.sum(F.when(F.col("__t").isNotNull() & F.col("__f").isNotNull(), 1).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("__t").isNull(), 1).otherwise(0)).alias("fp"), F.sum(F.when(F.col("__f").isNull(), 1).otherwise(0)).alias("fn"))
    _, _, f1 = f_measure(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn"))
    return both.withColumn("f1", F.round(f1, 6))


def tokens_13a(text: Column) -> Column:
    """Words of the standard BLEU tokenisation."""
    for a, b in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(a), F.lit(b))
    text = F.concat(F.lit(" "), text, F.lit(" "))
    for p, r in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "), (r"([^0-9])([\.,])", "$1 $2 "), (r"([\.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 ")):
        text = F.regexp_replace(text, p, r)
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def ngram_overlap(pairs: DataFrame, by: list[str], truth: str, found: str, n: int = 4) -> DataFrame:
    """Sums by size of n-gram: n-grams of found, and those of them that truth has, each as often as there at most. Counted within a row, so only sums are shuffled."""

    @F.arrow_udf("array<struct<size:int,total:long,clipped:long>>")
    def counted(truths: pa.Array, founds: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(truths.to_pylist(), founds.to_pylist()):
            a, b, row = a or [], b or [], []
            for k in range(1, n + 1):
                here, there = Counter(zip(*[b[i:] for i in range(k)])), Counter(zip(*[a[i:] for i in range(k)]))
                if here:
                    row.append({"size": k, "total": here.total(), "clipped": (here & there).total()})
            out.append(row)
        return pa.array(out, pa.list_(pa.struct([("size", pa.int32()), ("total", pa.int64()), ("clipped", pa.int64())])))

    each = pairs.select(*by, F.explode(counted(truth, found)).alias("x"))
    return each.groupBy(*by, F.col("x.size").alias("size")).agg(F.sum("x.total").alias("total"), F.sum("x.clipped").alias("clipped"))


def corpus_bleu(sums: DataFrame, lengths: DataFrame, by: list[str], n: int = 4) -> DataFrame:
    """BLEU of n-gram sums and lengths (by, truth_len, found_len), without smoothing."""
    logs = sums.groupBy(*by).agg(F.sum(F.when(F.col("clipped") > 0, F.log(F.col("clipped") / F.col("total"))).otherwise(F.lit(0.0))).alias("s"), F.min("clipped").alias("least"), F.count("*").alias("k"))
    ratio = F.when((F.col("truth_len") == 0) | (F.col("found_len") == 0), F.lit(1e-5)).otherwise(F.col("found_len") / F.col("truth_len"))
    brevity = F.when(ratio > 1, F.lit(1.0)).otherwise(F.exp(1 - 1 / ratio))
    score = F.when((F.col("k") == n) & (F.col("least") > 0), brevity * F.exp(F.col("s") / n)).otherwise(F.lit(0.0))
    return lengths.join(logs, by, "left").select(*by, F.round(F.coalesce(score, F.lit(0.0)), 6).alias("bleu"))


def segment_vote(tokens: DataFrame, segment: str, label: str) -> DataFrame:
    """The most frequent label of a segment; ties to the lowest."""
    counts = tokens.groupBy(segment, label).agg(F.count("*").alias("c"))
    return counts.groupBy(segment).agg(F.min(F.struct((-F.col("c")).alias("m"), label)).alias("b")).select(segment, F.col(f"b.{label}").alias(label), (-F.col("b.m")).alias("votes"))


def upper_median(df: DataFrame, by: str, value: Column) -> DataFrame:
    """Of the positive values of each group, that in the middle, the upper of two."""
    ranked = df.select(by, value.alias("v")).filter("v > 0")
    w = Window.partitionBy(by)
    placed = ranked.select(by, "v", F.row_number().over(w.orderBy("v")).alias("r"), F.count("*").over(w).alias("n"))
    return placed.filter(F.col("r") == F.floor(F.col("n") / 2) + 1).select(by, F.col("v").alias("median"))


def edge_histogram(df: DataFrame, by: str, value: str, step: float) -> DataFrame:
    return df.groupBy(by, F.bround(F.col(value) / step).cast("long").alias("k")).agg(F.count("*").alias("n"))


def band_edges(histogram: DataFrame, by: str) -> DataFrame:
    """Bands whose count with both neighbours is over one."""
    near = F.sum("n").over(Window.partitionBy(by).orderBy("k").rangeBetween(-1, 1))
    return histogram.withColumn("near", near).filter("near > 1")


def log_throughput(lines: DataFrame, by: str, order: str, text: str, keyword: str, skip: int = 0) -> DataFrame:
    """Average, least and greatest of the numbers after keyword, but for the first skip of a log."""
    found = lines.select(by, order, F.try_to_number(F.nullif(F.regexp_extract(text, rf"\Q{keyword}\E\s*([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")), F.lit("999999999.999999")).cast("double").alias("v")).filter("v is not null")
    kept = found.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("r") > skip)
    return kept.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("avg"), F.min("v").alias("min"), F.max("v").alias("max"))
