"""Joins of boxes: every one carries the page as its equi-key; what is left is a filter within the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.operators.sampling import numbered

SIDES = ("x0", "y0", "x1", "y1")


def renamed(df: DataFrame, prefix: str, page: str = "page_id") -> DataFrame:
    return df.select(*[F.col(c) if c == page else F.col(c).alias(prefix + c) for c in df.columns])


def on_page(left: DataFrame, right: DataFrame, where: Column | None = None, how: str = "inner", page: str = "page_id") -> DataFrame:
    """Left's columns with l_, right's with r_, joined on the page and where."""
    a, b = renamed(left, "l_", page), renamed(right, "r_", page)
    if where is None:
        return a.join(b, page, how)
    out = a.join(b.withColumnRenamed(page, "__page"), (F.col(page) == F.col("__page")) & where, how)
    return out if how in ("left_semi", "left_anti") else out.drop("__page")


class Side:
    """The box columns of one side of a join, made when asked for."""

    def __init__(self, prefix: str):
        self.prefix = prefix

    def __getitem__(self, i: int) -> Column:
        return F.col(self.prefix + SIDES[i])


LEFT, RIGHT = Side("l_"), Side("r_")


def region_lines(regions: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines of each region that their rectangles share a point with; a line may be in several."""
    return on_page(regions, lines, g.touches(LEFT, RIGHT))


def iou_pairs(truth: DataFrame, found: DataFrame, least: float = 0.5) -> DataFrame:
    pairs = on_page(truth, found, g.touches(LEFT, RIGHT))
    return pairs.withColumn("iou", g.overlap_ratio(LEFT, RIGHT)).filter(F.col("iou") >= least)


def dont_care(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Found boxes of which more than half lies in one ignored truth box."""
    inside = (g.intersection(LEFT, RIGHT) / g.area(LEFT) > 0.5) & F.col("r_ignored")
    return on_page(found, truth, g.touches(LEFT, RIGHT) & inside, "left_semi")


def nearest_cell(lines: DataFrame, cells: DataFrame, line: str = "box_id", cell: str = "box_id") -> DataFrame:
    """Of each line the cell with the least (1 - iou, corner distance, cell)."""
    pairs = on_page(lines, cells).select("page_id", F.col(f"l_{line}").alias("line_id"), F.col(f"r_{cell}").alias("cell_id"), (1 - g.overlap_ratio(LEFT, RIGHT)).alias("miss"), g.corner_distance(LEFT, RIGHT).alias("dist"))
    best = pairs.groupBy("page_id", "line_id").agg(F.min(F.struct("miss", "dist", "cell_id")).alias("b"))
    return best.select("page_id", "line_id", "b.cell_id", "b.miss", "b.dist")


def centre_in_cell(cells: DataFrame, lines: DataFrame) -> DataFrame:
    return on_page(cells, lines, g.holds_centre(LEFT, RIGHT))


def cell_of_line(cells: DataFrame, lines: DataFrame) -> DataFrame:
    """The first cell that holds each line's centre."""
    return centre_in_cell(cells, lines).groupBy("page_id", F.col("r_box_id").alias("line_id")).agg(F.min("l_box_id").alias("cell_id"))


def best_iou_of_rest(cells: DataFrame, lines: DataFrame, matched: DataFrame) -> DataFrame:
    """Lines without a match, each with the first cell of the highest overlap, if that is over 0. The overlap is taken of the convex hull of both boxes."""
    rest = lines.join(matched.select("page_id", F.col("line_id").alias("box_id")), ["page_id", "box_id"], "left_anti")
    pairs = on_page(rest, cells, g.touches(LEFT, RIGHT)).withColumn("iou", g.hull_ratio(LEFT, RIGHT)).filter("iou > 0")
    best = pairs.groupBy("page_id", F.col("l_box_id").alias("line_id")).agg(F.min(F.struct((-F.col("iou")).alias("m"), "r_box_id")).alias("b"))
    return best.select("page_id", "line_id", F.col("b.r_box_id").alias("cell_id"), (-F.col("b.m")).alias("iou"))


def nearest_centre(cells: DataFrame, lines: DataFrame) -> DataFrame:
    """Of each cell the line whose centre is nearest; a line may serve several cells."""
    (ax, ay), (bx, by) = g.centre(LEFT), g.centre(RIGHT)
    far = F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))
    pairs = on_page(cells, lines).withColumn("far", far)
    best = pairs.groupBy("page_id", F.col("l_box_id").alias("cell_id")).agg(F.min(F.struct("far", "r_box_id")).alias("b"))
    return best.select("page_id", "cell_id", F.col("b.r_box_id").alias("line_id"), "b.far")


def outside_figures(lines: DataFrame, figures: DataFrame) -> DataFrame:
    """Lines whose centre no figure holds."""
    return on_page(lines, figures, g.holds_centre(RIGHT, LEFT), "left_anti")


def inside_figures(lines: DataFrame, figures: DataFrame) -> DataFrame:
    return on_page(lines, figures, g.holds_centre(RIGHT, LEFT), "left_semi")


def unmatched(rows: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(matched.select(*keys).distinct(), keys, "left_anti")


def virtual_cells(rest: DataFrame, cells: DataFrame) -> DataFrame:
    """Numbers after the last cell of a page for the lines that are left over, in their order."""
    last = cells.groupBy("page_id").agg(F.max("box_id").alias("last"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("box_id"))
    return rest.join(last, "page_id", "left").select("page_id", F.col("box_id").alias("line_id"), (F.coalesce("last", F.lit(-1)) + rank).alias("cell_id"))


def neighbour_limits(boxes: DataFrame, share: float = 0.4) -> DataFrame:
    """How far each box can grow: the nearest right edge on its left and left edge on its right, of boxes that overlap it by more than share of the lower height."""
    high = F.least(LEFT[3] - LEFT[1], RIGHT[3] - RIGHT[1])
    level = (F.least(LEFT[3], RIGHT[3]) - F.greatest(LEFT[1], RIGHT[1]) > share * high) & (F.col("l_box_id") != F.col("r_box_id"))
    near = on_page(boxes, boxes, level).groupBy("page_id", F.col("l_box_id").alias("box_id")).agg(
        F.max(F.when(RIGHT[2] <= LEFT[0], RIGHT[2])).alias("left_limit"), F.min(F.when(RIGHT[0] >= LEFT[2], RIGHT[0])).alias("right_limit"))
    return boxes.select("page_id", "box_id").join(near, ["page_id", "box_id"], "left")


def edit_merge(base: DataFrame, edits: DataFrame, key: str, value: str) -> DataFrame:
    """base with edits (key, action, value, place): 'set' replaces, 'delete' removes, 'insert' appends after the largest key in order of place."""
    last = edits.filter("action <> 'insert'").groupBy(key).agg(F.max(F.struct("place", "action", value)).alias("e"))
    kept = base.join(last, key, "left").filter("e is null or e.action <> 'delete'").select(key, F.coalesce(F.col(f"e.{value}"), F.col(value)).alias(value))
    top = base.agg(F.coalesce(F.max(key), F.lit(-1)).alias("top"))
    new = numbered(edits.filter("action = 'insert'").select(value, "place"), [], ["place"], "n")
    return kept.unionByName(new.select((F.col("n") + top.scalar()).cast(base.schema[key].dataType).alias(key), value))


def first_link(links: DataFrame, head: str = "head", tail: str = "tail", order: str = "place") -> DataFrame:
    """The first relation of each tail."""
    return links.groupBy(tail).agg(F.min(F.struct(order, head)).alias("b")).select(F.col(f"b.{head}").alias(head), tail)


def golden_compare(found: DataFrame, golden: DataFrame, keys: list[str], value: str, atol: float = 1e-3, rtol: float = 1e-3) -> DataFrame:
    """Keys of either side with a verdict: same, differs, missing or extra."""
    a, b = found.select(*keys, F.col(value).alias("__a"), F.lit(True).alias("__x")), golden.select(*keys, F.col(value).alias("__b"), F.lit(True).alias("__y"))
    near = F.abs(F.col("__a") - F.col("__b")) <= atol + rtol * F.abs(F.col("__b"))
    verdict = F.when(F.col("__x").isNull(), "missing").when(F.col("__y").isNull(), "extra").when(near, "same").otherwise("differs")
    return a.join(b, keys, "full").select(*keys, verdict.alias("verdict"))


def series_table(series: DataFrame, chart: str = "chart_id") -> DataFrame:
    """Rows of series (chart, series, place, value) side by side: a row a place, gaps empty, as many as the longest has."""
    wide = series.groupBy(chart, "place").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("series", "value")))).alias("m"))
    names = series.groupBy(chart).agg(F.array_sort(F.collect_set("series")).alias("names"))
    return wide.join(names, chart).select(chart, "place", F.transform("names", lambda n: F.coalesce(F.element_at("m", n).cast("string"), F.lit(""))).alias("cells"))
