"""Token chunks, label maps, tiles, dates, font sizes, bilingual lines: smaller pieces of document layout."""

from __future__ import annotations

import difflib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUNGS = (0.8, 1.0, 1.45, 1.9, 2.4)


def bio_labels(names: list[str]) -> dict[str, int]:
    """O, then B- and I- of each label in upper case; other, others and ignore are none."""
    kept = [n.upper() for n in names if n.lower() not in ("other", "others", "ignore", "o")]
    return {label: i for i, label in enumerate(["O", *(f"{p}-{n}" for n in kept for p in "BI")])}


def token_chunks(df: DataFrame, tokens: str, size: int, first_only: bool = False) -> DataFrame:
    """A row a window of up to size tokens, in order."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0)), F.lit(size))
    cut = df.select("*", F.explode(F.slice(starts, 1, 1) if first_only else starts).alias("start"))
    return cut.withColumn("chunk", F.slice(tokens, F.col("start") + 1, size))


def chunk_entities(chunks: DataFrame, entities: DataFrame, key: str, size: int) -> DataFrame:
    """Entities (key, first, last, label) of each chunk that holds both ends, with places in the chunk."""
    both = chunks.select(key, "start").join(entities, key)
    inside = (F.col("first") >= F.col("start")) & (F.col("last") < F.col("start") + size)
    return both.filter(inside).withColumns({"first": F.col("first") - F.col("start"), "last": F.col("last") - F.col("start")})


def padded(tokens: Column, size: int, fill: int = 0, left: bool = False) -> tuple[Column, Column]:
    """(tokens filled up to size, mask of the true ones)."""
    short = F.greatest(F.lit(0), size - F.size(tokens))
    fills, ones, zeros = F.array_repeat(F.lit(fill), short), F.transform(tokens, lambda _: F.lit(1)), F.array_repeat(F.lit(0), short)
    return (F.concat(fills, tokens), F.concat(zeros, ones)) if left else (F.concat(tokens, fills), F.concat(ones, zeros))


def tiles(df: DataFrame, wide: str, high: str, size: int, step: int, most: int = 500) -> DataFrame:
    """A row a tile of an image; more than most of them are an error."""
    along = lambda c: F.sequence(F.lit(0), F.greatest(F.col(c).cast("int") - size + step, F.lit(step)) - 1, F.lit(step))
    counted = df.withColumns({"__y": along(high), "__x": along(wide)})
    fits = F.when(F.size("__y") * F.size("__x") <= most, F.col("__y")).otherwise(F.raise_error(F.lit(f"more than {most} tiles")).cast("array<int>"))
    return counted.withColumn("__y", fits).select(*df.columns, F.explode("__y").alias("tile_y"), "__x").select(*df.columns, "tile_y", F.explode("__x").alias("tile_x"))


def excel_date(value: Column, number_format: Column) -> Column:
    """Serial days as yyyy-MM-dd where the format has a y, m or d; else the number as text."""
    day = F.date_add(F.lit("1899-12-30").cast("date"), F.floor(value).cast("int"))
    return F.when(F.lower(number_format).rlike("[ymd]"), F.date_format(day, "yyyy-MM-dd")).otherwise(value.cast("string"))


def font_size(height: Column, median: Column, width: Column, n_chars: Column) -> Column:
    """The page's median times the rung nearest to a line's own share of it, no wider than its characters allow."""
    rungs = F.array(*map(F.lit, RUNGS))
    nearest = F.array_min(F.transform(rungs, lambda r: F.struct(F.abs(r - height / median).alias("far"), r.alias("rung"))))["rung"]
    return F.least(median * nearest, width / (F.greatest(n_chars, F.lit(1)) * 0.34))


def indent(left: Column, step: float = 9.0) -> Column:
    return F.bround(left / step) * step


def merge_bilingual(arabic: DataFrame, latin: DataFrame, key: str = "line_no", text: str = "text", score: str = "score") -> DataFrame:
    """Lines of two readings by number: the Latin one where the other has under two Arabic letters and its score is no worse; else the Arabic one, with Latin words that it lacks if those score over 0.5. Blank lines go."""
    a = arabic.select(key, F.col(text).alias("a"), F.col(score).alias("sa"))
    b = latin.select(key, F.col(text).alias("b"), F.col(score).alias("sb"))
    both = a.join(b, key, "full").na.fill("", ["a", "b"]).na.fill(0.0, ["sa", "sb"])
    letters = F.length("a") - F.length(F.regexp_replace("a", r"[\x{0600}-\x{06FF}]", ""))
    words = F.filter(F.split("b", r"\s+"), lambda w: w.rlike("[A-Za-z]") & ~F.contains(F.lower("a"), F.lower(w)))
    added = F.when((F.col("sb") > 0.5) & (F.size(words) > 0), F.concat_ws(" ", F.col("a"), F.array_join(words, " "))).otherwise(F.col("a"))
    merged = F.when((letters < 2) & ((F.col("sb") >= F.col("sa")) | F.col("b").rlike("[A-Za-z]{3}")), F.col("b")).otherwise(added)
    return both.select(key, F.trim(merged).alias("text")).filter("text <> ''")


def word_rate(target: str, found: str) -> float:
    """Share of a formula's words that the other has in order: the matcher's ratio, taken of the first one's length."""
    a, b = target.split(), found.split()
    if not a:
        return float(not b)
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() * (len(a) + len(b)) / len(a) / 2


def psnr(a: list[float], b: list[float]) -> float:
    """Peak signal to noise of 8-bit pixels; infinite for equal images."""
    error = sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) / max(1, len(a))
    return float("inf") if not error else 20 * math.log10(255 / math.sqrt(error))
