"""URL filters: host and path rules, else logistic regression on hashed character n-grams of host and path.

Everything here is DataFrame functions. The model is fitted by gradient descent on a small labelled URL table: with
L2 regularisation and zero start, each step's weights are a combination of the table's rows, so the descent runs on
one coefficient a row over their Gram matrix, and only its end is turned into a weight a bucket.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import text_of
from quire.llm.url_table import ALLOWED, BLOCKED, SHAPES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
BUCKETS, SIZES = 16_384, (3, 4, 5)
#: Rows that a training table may have; its Gram matrix has that many squared entries.
MAX_ROWS = 2000


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without :// or for null."""
    return F.translate(F.regexp_extract(text_of(url), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty without :// or for null."""
    return F.regexp_extract(text_of(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none does; rules: a short list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _grams(text: Column, kind: str, sizes=SIZES) -> Column:
    """The n-grams of kind + text between markers, each led by its kind."""
    chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")

    def of(n: int) -> Column:
        whole = F.filter(F.transform(chars, lambda _, i: F.slice(chars, i + 1, n)), lambda g: F.size(g) == n)
        return F.transform(whole, lambda g: F.concat(F.lit(kind), F.array_join(g, "")))

    return F.concat(*map(of, sizes))


def features(host: Column, path: Column, buckets: int = BUCKETS, sizes=SIZES) -> Column:
    """The distinct buckets of a URL's n-grams."""
    grams = F.concat(_grams(host, "h:", sizes), _grams(path, "p:", sizes))
    return F.array_distinct(F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(buckets)).cast("int")))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The default training table (url, blocked 0/1)."""
    both = [F.struct(F.lit(u).alias("url"), F.lit(label).alias("blocked")) for urls, label in ((BLOCKED, 1), (ALLOWED, 0)) for u in urls.split()]
    given = spark.range(1).select(F.explode(F.array(*both)).alias("r")).select("r.*")
    host = F.regexp_replace(host_of(F.col("url")), "^www[.]", "")
    forms = SHAPES.split()
    form = F.get(F.array(*map(F.lit, forms)), F.pmod(F.xxhash64(host), F.lit(len(forms))).cast("int"))
    return given.select(F.explode(F.array("url", F.replace(form, F.lit("{host}"), host))).alias("url"), "blocked")


@dataclass(frozen=True)
class UrlModel:
    weights: list[float]
    bias: float
    sizes: tuple[int, ...] = SIZES

    def log_odds(self, host: Column, path: Column) -> Column:
        """Log-odds that the URL is to be blocked. The features have unit length, as in training."""
        table = F.from_json(F.lit(json.dumps(self.weights)), "array<double>")
        found = features(host, path, len(self.weights), self.sizes)
        total = F.aggregate(found, F.lit(0.0), lambda s, b: s + F.get(table, b))
        return F.lit(self.bias) + total / F.sqrt(F.greatest(F.size(found), F.lit(1)).cast("double"))


def train(labelled: DataFrame, buckets: int = BUCKETS, sizes=SIZES, steps: int = 100, rate: float = 16.0, bias_rate: float = 2.0, decay: float = 1e-4) -> UrlModel:
    """Fit to (url, blocked) rows, of which there may be MAX_ROWS; rows with a null label are left out.

    The regression has one coefficient for each row a; its scores are K a + b with K the rows' Gram matrix, so each of
    the ``steps`` is a fold over that matrix. No rows, or one label alone, give a model of that label's log-odds.
    """
    rows = labelled.filter("blocked is not null").select("blocked", host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p"))
    found = rows.select("blocked", features(F.col("h"), F.col("p"), buckets, sizes).alias("f"))
    every = found.agg(F.sort_array(F.collect_list(F.struct("f", F.col("blocked").cast("double").alias("y")))).alias("x"))
    n = found.count()
    if n > MAX_ROWS:
        raise ValueError(f"the labelled URL table has {n} rows; {MAX_ROWS} are the bound")
    if not n:
        return UrlModel([0.0] * buckets, 0.0, tuple(sizes))
    gram = F.transform("x", lambda a: F.transform("x", lambda b: F.size(F.array_intersect(a["f"], b["f"])) / F.sqrt(F.size(a["f"]).cast("double") * F.size(b["f"]))))
    # The exchange keeps the optimiser from putting the matrix's expression into every step.
    base = every.select("x", gram.alias("k"), F.transform("x", lambda a: a["y"]).alias("y")).repartition(1)
    zero = F.struct(F.array_repeat(F.lit(0.0), n).alias("a"), F.lit(0.0).alias("b"))

    # The errors are needed twice in a step; a one-element array holds them so that they are computed once.
    def step(state: Column, _: Column) -> Column:
        score = F.transform("k", lambda row: F.aggregate(F.zip_with(row, state["a"], lambda k, a: k * a), state["b"], lambda s, v: s + v))
        off = F.zip_with(score, "y", lambda s, y: F.lit(1.0) / (F.lit(1.0) + F.exp(-s)) - y)
        return F.element_at(
            F.transform(F.array(off), lambda d: F.struct(
                F.zip_with(state["a"], d, lambda a, e: a * (1 - rate * decay) - e * (rate / n)).alias("a"),
                (state["b"] - F.aggregate(d, F.lit(0.0), lambda s, e: s + e) * (bias_rate / n)).alias("b"))), 1)

    fitted = base.select("x", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), zero, step).alias("m"))
    summed = (
        fitted.select(F.col("m.b").alias("bias"), F.explode(F.arrays_zip("x", F.col("m.a").alias("a"))).alias("r"))
        .select("bias", (F.col("r.a") / F.sqrt(F.size("r.x.f").cast("double"))).alias("w"), F.explode("r.x.f").alias("bucket"))
        .groupBy("bucket").agg(F.sum("w").alias("w"), F.first("bias").alias("bias"))
    )
    weights, bias = [0.0] * buckets, 0.0
    for r in summed.collect():  # one row a bucket at most
        weights[r["bucket"]], bias = r["w"], r["bias"]
    return UrlModel(weights, bias, tuple(sizes))


def judge_urls(pages: DataFrame, model: UrlModel, rules=RULES, url: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict and log_odds in place of columns of those names.

    verdict: that of the longest rule that fits, else block where the model's log-odds are over 0, else allow (so at just
    0). A null url, or one without ://, has empty host and path; the model judges it like any other. Repeated rows are
    kept; an empty table gives none; of a long URL every n-gram counts, once.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    split = pages.withColumns({"host": host, "path": path})
    host, path = F.col("host"), F.col("path")
    rule, verdict = rule_of(host, path, rules)
    scored = split.withColumns({"rule": rule, "verdict": verdict, "log_odds": model.log_odds(host, path)})
    return scored.withColumn("verdict", F.coalesce("verdict", F.when(F.col("log_odds") > 0, "block").otherwise("allow")))
