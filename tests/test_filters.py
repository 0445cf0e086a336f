from pyspark.sql import functions as F

from quire.operators import filters

BOX = "page_id long, box_id long, x0 double, y0 double, x1 double, y1 double, score double, label string"


def boxes(spark, *rows):
    return spark.createDataFrame(list(rows), BOX)


def test_scores_and_cuts(spark):
    b = boxes(spark, (1, 1, -5.0, 2.7, 30.9, 90.0, 0.5, "a"), (1, 2, 0.0, 0.0, 3.9, 50.0, None, "a"), (1, 3, 0.0, 0.0, 50.0, 3.0, 0.4, "a"))
    assert [r.box_id for r in filters.by_score(b, 0.5).collect()] == [1]
    assert [(r.box_id, r.x0, r.y0, r.x1, r.y1) for r in filters.clipped(b, 20, 40).collect()] == [(1, 0, 2, 19, 39)]


def test_not_above(spark):
    lines = boxes(spark, (1, 1, 0.0, 0.0, 1.0, 9.0, 1.0, "a"), (1, 2, 0.0, 0.0, 1.0, 10.0, 1.0, "a"), (2, 3, 0.0, 0.0, 1.0, 1.0, 1.0, "a"))
    cells = boxes(spark, (1, 1, 0.0, 10.0, 1.0, 20.0, 1.0, "a"), (1, 2, 0.0, 15.0, 1.0, 20.0, 1.0, "a"))
    assert sorted(r.box_id for r in filters.not_above(lines, cells).collect()) == [2, 3]
    assert filters.not_above(lines.limit(0), cells).count() == 0


def test_ranks_and_ties(spark):
    b = boxes(spark, *[(1, i, 0.0, float(i % 2), 1.0, 1.0, s, k) for i, (s, k) in enumerate([(0.9, "a"), (0.9, "a"), (0.8, "a"), (0.7, "b"), (0.1, "b")])])
    assert [(r.box_id, r["rank"]) for r in filters.top_candidates(b, 2, 5, 0.1).orderBy("rank").collect()] == [(0, 1), (1, 2), (3, 3)]
    assert [r.box_id for r in filters.first_of_page(b, 2).orderBy("box_id").collect()] == [0, 1]
    assert [r.box_id for r in filters.by_top(b).orderBy("place").collect()] == [0, 2, 4, 1, 3]


def test_expressions(spark):
    row = spark.createDataFrame([([0.2, 0.5, 0.5], "de", '﻿"1", 2,3,4,5,6,7,8, "x, y"')], "s array<double>, l string, c string")
    best, score = filters.best_class(F.col("s"))
    points, text = filters.csv_label(F.col("c"))
    wide, high = filters.formula_bucket(F.lit(33), F.lit(192))
    none, _ = filters.formula_bucket(F.lit(31), F.lit(100))
    r = row.select(best.alias("b"), score.alias("s"), filters.class_index(F.col("l"), ["en", "de"]).alias("k"), filters.class_index(F.lit("x"), ["en"]).alias("x"), points.alias("p"), text.alias("t"), wide.alias("w"), high.alias("h"), none.alias("n")).first()
    assert (r.b, r.s, r.k, r.x, r.t, r.w, r.h, r.n) == (1, 0.5, 1, None, "x, y", 48, 192, None)
    assert r.p == [[1, 2], [3, 4], [5, 6], [7, 8]]


def test_body_size(spark):
    runs = spark.createDataFrame([(1, 1, 9), (1, 2, 8), (1, 3, None), (1, 4, None), (2, 1, None)], "d long, o long, size long")
    assert sorted(map(tuple, filters.body_size(runs, "d", "o", "size").collect())) == [(1, 9), (2, 16)]
