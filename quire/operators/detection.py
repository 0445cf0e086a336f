"""Detection metrics: one-to-one matches within a page, counts that combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import joins, kernels, metrics

LEFT, RIGHT = joins.LEFT, joins.RIGHT


def at_thresholds(truth: DataFrame, found: DataFrame, least: list[float], overlap: float = 0.5) -> DataFrame:
    """Micro precision, recall and hmean of boxes found with each least score.

    Truth with ``ignored`` doesn't count, nor do found boxes of which more than half lies in one such. A pair matches
    if its overlap is over the constraint and neither is taken, in order of truth, then found. Pages are matched apart;
    only pairs that overlap enough are gathered.
    """
    known = truth.filter("not ignored")
    out = joins.dont_care(truth, found).select("page_id", F.col("l_box_id").alias("box_id"))
    cared = found.join(out, ["page_id", "box_id"], "left_anti")
    levels = F.array(*[F.lit(float(t)) for t in least])
    at = lambda score: F.explode(F.filter(levels, lambda t: score >= t)).alias("threshold")
    pairs = joins.iou_pairs(known, cared, overlap).filter(F.col("iou") > overlap).select("page_id", F.col("l_box_id").alias("gt_id"), F.col("r_box_id").alias("det_id"), "iou", at(F.col("r_score")))
    matched = kernels.per_page(pairs, kernels.match_in_order, "page_id long, threshold double, gt_id long", "page_id", "threshold").groupBy("threshold").agg(F.count("*").alias("matched"))
    sizes = cared.select(at(F.col("score"))).groupBy("threshold").agg(F.count("*").alias("det_care"))
    total = known.agg(F.count("*")).scalar()
    counts = truth.sparkSession.createDataFrame([(float(t),) for t in least], "threshold double").join(sizes, "threshold", "left").join(matched, "threshold", "left")
    return metrics.detection(counts.na.fill(0).withColumn("gt_care", total), ["threshold"])
