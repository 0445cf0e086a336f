"""Filters and cuts of boxes and labels: by score, size, place, and rank within a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_score(boxes: DataFrame, least: float, score: str = "score") -> DataFrame:
    """Boxes that score at least so much; a null score goes."""
    return boxes.filter(F.col(score) >= least)


def clipped(boxes: DataFrame, width: int, height: int, side: int = 3) -> DataFrame:
    """Boxes cut to the picture, with whole numbers as corners (towards zero); those not wider or not higher than side go."""

    def inside(c: str, most: int) -> Column:
        return F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(most - 1.0)).cast("long")

    cut = boxes.withColumns({"x0": inside("x0", width), "y0": inside("y0", height), "x1": inside("x1", width), "y1": inside("y1", height)})
    return cut.filter((F.col("x1") - F.col("x0") > side) & (F.col("y1") - F.col("y0") > side))


def not_above(lines: DataFrame, cells: DataFrame, page: str = "page_id") -> DataFrame:
    """Lines that don't end above the top of their page's cells; pages without cells keep all."""
    top = cells.groupBy(page).agg(F.min("y0").alias("__top"))
    return lines.join(top, page, "left").filter(F.col("__top").isNull() | (F.col("y1") >= F.col("__top"))).drop("__top")


def class_index(label: Column, classes: list[str]) -> Column:
    """A label's place among the classes, from 0; null if it is none of them."""
    place = F.array_position(F.array(*map(F.lit, classes)), label) - 1
    return F.when(place >= 0, place)


def top_candidates(boxes: DataFrame, candidates: int, keep: int, least: float, page: str = "page_id", label: str = "label", score: str = "score", box: str = "box_id") -> DataFrame:
    """The candidates of a page and class that score above least, of them its best (ties to the smaller id), and of those the page's best; with their rank."""
    best = boxes.filter(F.col(score) > least).withColumn("__r", F.row_number().over(Window.partitionBy(page, label).orderBy(F.desc(score), box)))
    ranked = best.filter(F.col("__r") <= candidates).withColumn("rank", F.row_number().over(Window.partitionBy(page).orderBy(F.desc(score), box)))
    return ranked.filter(F.col("rank") <= keep).drop("__r")


def first_of_page(boxes: DataFrame, most: int, page: str = "page_id", order: str = "box_id") -> DataFrame:
    """The first so many boxes of each page, in their order: a detector's cap on its contours."""
    return boxes.withColumn("__r", F.row_number().over(Window.partitionBy(page).orderBy(order))).filter(F.col("__r") <= most).drop("__r")


def by_top(boxes: DataFrame, page: str = "page_id", box: str = "box_id") -> DataFrame:
    """Boxes with their place on the page by upper edge alone (ties to the smaller id)."""
    return boxes.withColumn("place", F.row_number().over(Window.partitionBy(page).orderBy("y0", box)))


def best_class(scores: Column) -> tuple[Column, Column]:
    """(class, score) of the best class of an array of scores, the first of equal ones; null for an empty array."""
    most = F.array_max(scores)
    place = F.array_position(scores, most) - 1
    return F.when(most.isNotNull(), place), most


def formula_bucket(width: Column, height: Column, step: int = 16) -> tuple[Column, Column]:
    """Sides of the bucket of a formula's picture: rounded up to a multiple of step. Sides beyond 672 by 192, or below 32, have none."""
    fits = width.between(32, 672) & height.between(32, 192)
    return tuple(F.when(fits, (F.ceil(v / step) * step).cast("long")) for v in (width, height))


def csv_label(line: Column) -> tuple[Column, Column]:
    """(points, text) of a label line of eight numbers and a text, which may hold commas; spaces and quotes around the numbers go, as does a byte order mark."""
    parts = F.split(F.regexp_replace(line, "^﻿", ""), ",", 9)
    numbers = F.transform(F.slice(parts, 1, 8), lambda p: F.regexp_replace(p, "[\\s\"']", "").cast("long"))
    points = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.array(F.get(numbers, 2 * i), F.get(numbers, 2 * i + 1)))
    return points, F.regexp_replace(F.get(parts, F.lit(8)), "^[\\s\"']+|[\\s\"']+$", "")


def body_size(runs: DataFrame, doc: str, order: str, size: str, default: int = 16) -> DataFrame:
    """(doc, size): the commonest size of a document's runs, the first seen of equally common ones; default if none has one."""
    counts = runs.groupBy(doc, size).agg(F.count(size).alias("n"), F.min(order).alias("first"))
    return counts.groupBy(doc).agg(F.coalesce(F.max_by(size, F.when(F.col(size).isNotNull(), F.struct("n", -F.col("first")))), F.lit(default).cast("long")).alias(size))
