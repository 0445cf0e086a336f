import random
import statistics

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.operators import kernels as k
from quire.operators import sampling, windows


def box(i, x, y, w=10, h=10, score=0.5, **more):
    return {"page_id": 1, "box_id": i, "x0": float(x), "y0": float(y), "x1": float(x + w), "y1": float(y + h), "score": score, "label": "A", "text": f"t{i}"} | more


boxes = st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60), st.integers(1, 30), st.integers(1, 30), st.integers(0, 10)), max_size=14).map(lambda rows: [box(i, x, y, w, h, s / 10) for i, (x, y, w, h, s) in enumerate(rows)])


@settings(max_examples=60, deadline=None)
@given(boxes)
def test_suppression(rows):
    kept = k.hard_nms(rows)
    assert k.hard_nms(kept) == kept
    assert all(k.iou(a, b, 1e-5) <= 0.5 for a in kept for b in kept if a is not b)
    ids = {r["box_id"] for r in kept}
    assert all(any(k.iou(r, b, 1e-5) > 0.5 and (b["score"], -b["box_id"]) > (r["score"], -r["box_id"]) for b in kept) for r in rows if r["box_id"] not in ids)
    assert sum(r["score"] for r in k.locality_nms(rows, 0.99)) <= sum(r["score"] for r in rows) + 1e-9
    soft = k.soft_nms(rows)
    assert all(r["score"] >= 0.3 for r in soft[1:]) and len(soft) <= len(rows)
    assert k.label_dedup(k.label_dedup(rows)) == k.label_dedup(rows)


@settings(max_examples=60, deadline=None)
@given(boxes)
def test_orders_are_permutations(rows):
    for order in (k.reading_order, lambda r: k.reading_order(r, 20, 1), lambda r: k.two_columns(r, 90), k.level_rows, lambda r: k.level_rows(r, running=True, rtl=True), k.table_rows):
        assert sorted(r["box_id"] for r in order(rows)) == [r["box_id"] for r in rows]
    if rows:
        first = min(rows, key=lambda r: (r["y0"], r["x0"], r["box_id"]))
        assert k.reading_order(rows, 20, 1)[0]["box_id"] == first["box_id"] or len(rows) > 1


@settings(max_examples=60, deadline=None)
@given(boxes)
def test_merging_ends(rows):
    merged = k.merge_fragments(rows)
    assert k.merge_fragments(merged) == merged
    assert len(k.merge_words(rows)) <= len(rows)


def test_fragments_take_later_boxes_only():
    one = lambda rows: [(r["box_id"], r["x0"], r["x1"]) for r in k.merge_fragments(rows)]
    assert one([box(0, 0, 0), box(1, 15, 8), box(2, 30, 0)]) == [(0, 0.0, 40.0)]
    assert one([box(0, 15, 0), box(1, 0, 0)]) == [(0, 15.0, 25.0), (1, 0.0, 10.0)]  # the left one comes later
    assert one([box(0, 0, 0), box(1, 30, 0), box(2, 15, 0)]) == [(0, 0.0, 40.0)]  # a second pass takes the far one
    assert one([box(0, 0, 0), box(1, 15, 11)]) == [(0, 0.0, 10.0), (1, 15.0, 25.0)]


def test_suppression_is_within_a_class():
    two = [box(0, 0, 0, label="A"), box(1, 0, 0, label="B"), box(2, 0, 0, label="B")]
    assert [r["box_id"] for r in k.hard_nms(two)] == [0, 1] and [r["box_id"] for r in k.hard_nms(two, by=None)] == [0]


def hull(points):
    points = sorted(set(points))
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    out = []
    for side in (points, points[::-1]):
        chain = []
        for p in side:
            while len(chain) > 1 and turn(chain[-2], chain[-1], p) <= 0:
                chain.pop()
            chain.append(p)
        out += chain[:-1]
    return out


def test_hull_of_two_rectangles(spark):
    rng = random.Random(3)
    rows = [tuple(float(v) for b in range(2) for x, y in [(rng.randint(0, 20), rng.randint(0, 20))] for v in (x, y, x + rng.randint(1, 15), y + rng.randint(1, 15))) for _ in range(300)]
    names = [f"{s}{c}" for s in "ab" for c in ("x0", "y0", "x1", "y1")]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    found = df.select(g.hull_area(g.box("a"), g.box("b")).alias("h"), *names).collect()
    for r in found:
        corners = [(r[s + x], r[s + y]) for s in "ab" for x in ("x0", "x1") for y in ("y0", "y1")]
        assert abs(r["h"] - abs(g.polygon_area(hull(corners)))) < 1e-9


def test_numbers_over_stretches(spark):
    rows = [(rng.choice("ab") if i % 9 else None, i * 7919 % 100_000) for rng in [random.Random(4)] for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k long")
    found = {(r["g"], r["k"]): r["n"] for r in sampling.numbered(df, ["g"], ["k"], "n", F.floor(F.col("k") / 1000)).collect()}
    for group in ("a", "b", None):
        assert [found[group, key] for key in sorted(key for name, key in rows if name == group)] == list(range(1, sum(name == group for name, _ in rows) + 1))
    medians = windows.sliding_median(df.withColumn("g", F.lit("x")).withColumn("v", F.col("k") * 1.0), "g", "k", "v", 5, size=16).collect()
    keys = sorted(key for _, key in rows)
    assert {r["k"]: r["median"] for r in medians} == {key: statistics.median(keys[max(0, i - 4) : i + 1]) for i, key in enumerate(keys)}


def test_matching():
    pairs = [{"gt_id": 1, "det_id": 1, "iou": 0.6}, {"gt_id": 1, "det_id": 2, "iou": 0.9}, {"gt_id": 2, "det_id": 2, "iou": 0.95}, {"gt_id": 2, "det_id": 1, "iou": 0.5}]
    assert [(p["gt_id"], p["det_id"]) for p in k.match_by_iou(pairs)] == [(2, 2), (1, 1)]
    assert [(p["gt_id"], p["det_id"]) for p in k.match_in_order(pairs)] == [(1, 1), (2, 2)]
    pairs[0]["ignored"] = True
    assert [(p["gt_id"], p["det_id"]) for p in k.match_in_order(pairs)] == [(1, 2)]


def test_reading_order_swaps_level_neighbours():
    assert [r["box_id"] for r in k.reading_order([box(0, 50, 0), box(1, 10, 4), box(2, 0, 40)])] == [1, 0, 2]
    assert [r["box_id"] for r in k.table_rows([box(0, 5, 0), box(1, 5, 1), box(2, 0, 2)])] == [2, 0, 1]
    assert [r["text"] for r in k.merge_words([box(0, 0, 0), box(1, 12, 1), box(2, 60, 0)])] == ["t0 t1", "t2"]


def test_components():
    rng = random.Random(0)
    for _ in range(50):
        edges = [(rng.randrange(9), rng.randrange(9), rng.random()) for _ in range(12)]
        means = {}
        for a, b, s in edges:
            means.setdefault(frozenset((a, b)), []).append(s)
        links = [tuple(p) for p, s in means.items() if len(p) == 2 and sum(s) / len(s) >= 0.5]
        label = {x: x for p in links for x in p}
        for _ in range(10):
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        assert k.components(edges) == label


def test_deteval():
    whole = box(0, 0, 0, 100, 10)
    assert k.deteval([whole], [whole]) == {"recall_sum": 1.0, "precision_sum": 1.0, "n_truth": 1, "n_found": 1}
    halves = [box(1, 0, 0, 50, 10), box(2, 50, 0, 50, 10)]
    assert k.deteval([whole], halves)["recall_sum"] == 0.8 and k.deteval([whole], halves)["precision_sum"] == 1.6
    assert k.deteval(halves, [whole])["precision_sum"] == 0.8
    assert k.deteval([whole | {"ignored": True}], halves)["n_found"] == 0
