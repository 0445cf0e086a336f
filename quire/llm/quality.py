"""Quality by a regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fresh, raw_texts, remainder, text_of

#: Classes of bytes: 0 other signs, 1 lower-case, 2 upper-case, 3 digits, 4 spaces, 5 line ends, 6 full stop and comma, 7 lead bytes of letters beyond ASCII, 8 their other bytes.
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[9, 11, 12, 32]], _CLASS[[10, 13]], _CLASS[[46, 44]], _CLASS[192:], _CLASS[128:192] = 1, 2, 3, 4, 5, 6, 7, 8
NAMES = ["words", "word_length", "word_length_spread", "signs", "upper", "digits", "stops", "distinct", "repeated", "short_words", "top_word", "bare_signs", "line_length"]
#: Labelled rows that a model is fitted on at most (those with the least hash of the id), share of the pooled covariance, share of its mean variance.
SAMPLE, POOLED, RIDGE = 20_000, 0.1, 1e-3


def statistics_of(text: bytes) -> list[float]:
    """The transformed statistics of one text in UTF-8: logarithms of counts, square roots of shares."""
    if not text:
        return [0.0] * len(NAMES)
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=9)
    signs, low, up, digits, _, lines, stops, wide, _ = kinds.tolist()
    shown = max(1, signs + low + up + digits + stops + wide)
    words = text.split()
    n = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    same = sum(map(bytes.__eq__, words, words[1:]))
    return [
        float(np.log1p(len(words))), float(np.log(1 + sizes.mean())), float(np.log(1 + sizes.std())), (signs / shown) ** 0.5, (up / shown) ** 0.5,
        (digits / shown) ** 0.5, (stops / shown) ** 0.5, (len(counts) / n) ** 0.5, (same / n) ** 0.5, float((sizes <= 3).mean()) ** 0.5,
        (max(counts.values(), default=0) / n) ** 0.5, (sum(counts.get(s, 0) for s in (b"|", b"-", b"*", b"#", b">", b"/")) / n) ** 0.5, float(np.log(shown / (lines + 1))),
    ]


def statistics(text: Column) -> Column:
    """The statistics of a text column as an array of doubles; null counts as empty."""

    @F.arrow_udf("array<double>")
    def made(texts: pa.Array) -> pa.Array:
        return pa.array([statistics_of(t) for t in raw_texts(texts)], pa.list_(pa.float64()))

    return made(text_of(text))


@dataclass(frozen=True)
class Discriminant:
    """Of each class (0, 1): its mean, the inverse of its covariance's Cholesky factor, and log prior less half the log determinant."""

    means: np.ndarray
    whiten: np.ndarray
    offsets: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 for rows of x."""
        if not len(x):
            return np.zeros(0)
        d = [o - 0.5 * (((x - m) @ w.T) ** 2).sum(1) for m, w, o in zip(self.means, self.whiten, self.offsets)]
        return 1 / (1 + np.exp(np.clip(d[0] - d[1], -700, 700)))


def fit(x: np.ndarray, y: np.ndarray, pooled: float = POOLED, ridge: float = RIDGE) -> Discriminant:
    """Class covariances, shrunk towards the pooled one and that towards its mean variance; factored once, here.

    A class without rows has the pooled mean and a prior of half a row.
    """
    p = x.shape[1]
    mean = x.mean(0) if len(x) else np.zeros(p)
    groups = [x[y == c] for c in (0, 1)]
    means = [g.mean(0) if len(g) else mean for g in groups]
    centred = [g - m for g, m in zip(groups, means)]
    shared = sum(c.T @ c for c in centred) / max(1, len(x))
    target = np.eye(p) * max(np.trace(shared) / p, 1e-6)
    whiten, offsets = [], []
    for g, c in zip(groups, centred):
        own = c.T @ c / len(g) if len(g) else shared
        weight = min(1.0, pooled + p / (p + len(g)))
        cov = (1 - ridge) * ((1 - weight) * own + weight * shared) + ridge * target
        factor = np.linalg.cholesky(cov)
        whiten.append(np.linalg.inv(factor))
        offsets.append(np.log((len(g) + 0.5) / (len(x) + 1)) - np.log(np.diag(factor)).sum())
    return Discriminant(np.array(means), np.array(whiten), np.array(offsets))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, sample: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, y) of at most ``sample`` labelled rows outside the held fold: those whose ids have the least hashes.

    An id with labels that differ takes the larger; of rows that share an id, that with the least text counts. Null ids,
    labels and those other than 0 and 1 are left out.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(label).cast("int").alias("__y"))
    marks = marks.filter((remainder("__id", folds) != held) & F.col("__y").isin(0, 1)).groupBy("__id").agg(F.max("__y").alias("__y"))
    chosen = marks.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    return texts_of(docs, chosen, doc_id, text).select("text", F.col("__y").alias("y"))


def texts_of(docs: DataFrame, chosen: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """chosen, a bounded table with the column __id, with the least text of each id that docs has; only rows of these ids move."""
    there = docs.select(F.col(doc_id).cast("long").alias("__id"), text_of(text).alias("__text"))
    return there.join(F.broadcast(chosen), "__id").groupBy(*chosen.columns).agg(F.min("__text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held: int = 1, sample: int = SAMPLE, **names) -> Discriminant:
    """A discriminant of labels outside the held fold; the driver gets ``sample`` rows of statistics, not texts."""
    rows = training_rows(docs, labels, label, folds, held, sample, **names).select(statistics(F.col("text")).alias("x"), "y").toPandas()
    x = np.array(rows["x"].tolist(), np.float64).reshape(-1, len(NAMES))
    return fit(x, rows["y"].to_numpy(np.int64))


def score(text: Column, model: Discriminant) -> Column:
    """The probability of label 1 for a text column; null counts as empty."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        x = np.array([statistics_of(t) for t in raw_texts(texts)], np.float64).reshape(-1, len(NAMES))
        return pa.array(model.score(x))

    return scored(text_of(text))


def classify(docs: DataFrame, model: Discriminant, folds: int = 3, held: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs, repeated ones too.

    A null id is in no fold; a null text is an empty one, which is scored like any other; texts are scored whole, however
    long; scores of just one half are label 1; an empty table gives no rows; other columns aren't read.
    """
    scored = docs.select(F.col(doc_id).cast("long").alias("doc_id"), score(F.col(text), model).alias("score"))
    return scored.select("doc_id", (remainder("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Discriminant, text: str = "text") -> DataFrame:
    """docs without rows that score under one half; columns stay as they are, whatever their names. Null and empty texts are scored like any other; repeated rows share their fate."""
    name = fresh(docs.columns, "quality_score")
    return docs.withColumn(name, score(F.col(text), model)).filter(F.col(name) >= 0.5).drop(name)
