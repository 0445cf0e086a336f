import numpy as np
from pyspark.sql import functions as F

from quire.llm import ann


def brute(rows, k=5):
    fine = {i: np.array(v, np.float64) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in fine:
        if q % 50 == 0:
            scores = sorted((-(fine[q] @ v) / (np.sqrt(fine[q] @ fine[q]) * np.sqrt(v @ v)), i) for i, v in fine.items() if i != q)
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def found(spark, rows, k=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    out = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0, k).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


def test_odd_rows_copies_and_ties(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(8).astype(np.float32).tolist(), "s") for i in range(120)]
    rows += [(200 + i, rows[50][1], "s") for i in range(40)] + [(300 + i, rows[3][1], "s") for i in range(9)]
    rows += [(400, None, "s"), (450, [0.0] * 8, "s"), (500, [1.0, None] * 4, "s"), (550, [float("nan")] * 8, "s"), (600, [float("inf")] * 8, "s"), (None, rows[1][1], "s"), rows[0], rows[7]]
    got, expected = found(spark, rows), brute([r[:2] for r in rows])
    assert got.keys() == expected.keys()
    for q in got:
        assert np.allclose([s for _, s in got[q]], [s for _, s in expected[q]], atol=1e-12)
        # Scores that differ in the last place only may change places, but copies come in the order of their ids.
        assert [i for i, s in got[q] if s > 1 - 1e-12] == [i for i, s in expected[q] if s > 1 - 1e-12]


def test_few_rows(spark):
    assert found(spark, [(50, [1.0, 0.0], "s")]) == {}
    assert [i for i, _ in found(spark, [(50, [1.0, 0.0], "s"), (3, [0.0, 1.0], "s"), (2, [1.0, 1.0], "s")])[50]] == [2, 3]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.search(empty, F.col("vec_id") % 50 == 0).count() == 0


def test_recall(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist(), "s") for i, v in enumerate(rng.standard_normal((3000, 24)).astype(np.float32))]
    got, expected = found(spark, rows), brute([r[:2] for r in rows])
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert hits / (5 * len(expected)) >= 0.9


def test_searches_go_on_until_all_kept_are_expanded(spark):
    angles = np.linspace(0, 3, 40)
    points = ann.nodes_of(spark.createDataFrame([(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angles)], "id long, vec array<float>"), "id", "vec", 6)
    points = points.select("node", ann.packed().alias("packed"))
    graph = spark.createDataFrame([(i, [j for j in (i - 2, i - 1, i + 1, i + 2) if 0 <= j < 40]) for i in range(40)], "node long, ids array<long>")
    graph = graph.select("node", "ids", F.transform("ids", lambda _: F.lit(0.9)).alias("sims"))
    # Two steps a round lead from one end to the other: 20 rounds, and one that finds nothing open.
    found = ann.greedy(points.filter("node = 0"), graph, points).first()["ids"]
    assert sorted(found) == list(range(40))


def test_descent_goes_on_until_lists_settle(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = rng.standard_normal((600, 4)).astype(np.float32)
    nodes = ann.nodes_of(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "id long, vec array<float>"), "id", "vec", 6)
    points = nodes.select("node", ann.packed().alias("packed"))
    # Each node starts with the next one only: lists of K take more than three rounds to be the nearest.
    monkeypatch.setattr(ann, "start", lambda points, count: points.select("node", F.array((F.col("node") + 1) % 600).alias("ids"), F.array(F.lit(-1.0)).alias("sims")))
    got = {r["node"]: set(r["ids"]) for r in ann.neighbour_graph(points).collect()}
    x = ann.unit(rows)
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    true = np.argsort(-sims, axis=1)[:, : ann.K]
    assert np.mean([len(got[i] & set(true[i].tolist())) / ann.K for i in range(600)]) > 0.9


def test_width_grows_with_the_nodes():
    assert ann.width_for(10_000) == ann.WIDTH and ann.width_for(500_000) == 5000


def test_near_copies_are_told_apart(spark):
    rng = np.random.default_rng(3)
    copies = rng.standard_normal(64) + 0.001 * rng.standard_normal((1200, 64))
    rows = [(i, v.tolist(), "s") for i, v in enumerate(np.r_[copies, rng.standard_normal((600, 64))].astype(np.float32))]
    got, expected = found(spark, rows), brute([r[:2] for r in rows])
    among = [q for q in expected if q < 1200]
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in among)
    assert hits / (5 * len(among)) >= 0.9


def test_planes_do_not_grow_with_the_table():
    import numpy as np

    sample = np.random.default_rng(0).standard_normal((4096, 8))
    sizes = {n: sum(a.size + b.size + c.size for a, b, c in ann.planes(sample, n, np.random.default_rng(1))) for n in (10_000, 10**6, 10**9)}
    assert sizes[10**9] - sizes[10**6] == ann.TREES * 10 * 8 and sizes[10**9] < 20_000


def test_rounds_leave_one_table_each(spark, monkeypatch):
    """Graphs, searches and components keep the last round's table alone."""
    import os

    from quire.llm import common, components

    made = []
    scratch = common.scratch
    monkeypatch.setattr(common, "scratch", lambda s, tag: made.append((tag, scratch(s, tag))) or made[-1][1])
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 8)))]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0, width=20)
    assert found.count() == 30
    components.connected_components(spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")).count()
    left = [tag for tag, path in made if os.path.exists(path.removeprefix("file:"))]
    assert sum(tag == "search" for tag, _ in made) > 2 and sum(tag == "edges" for tag, _ in made) > 3
    assert left.count("graph") == left.count("search") == 1 and left.count("edges") == 2  # the search's and the components'


def test_slices_bound_what_is_moved_and_find_as_much(spark, monkeypatch):
    """A step that would move more than MOVED bytes and half the table is done in slices; results stay whole, and a slice leaves no table of its own but its results."""
    import os

    from quire.llm import common

    made, steps = [], []
    scratch, descend, start = common.scratch, ann.descend, ann.start
    monkeypatch.setattr(common, "scratch", lambda s, tag: made.append((tag, scratch(s, tag))) or made[-1][1])
    monkeypatch.setattr(ann, "descend", lambda *a: steps.append(a[2:]) or descend(*a))
    monkeypatch.setattr(ann, "start", lambda *a: steps.append(a[2:]) or start(*a))
    monkeypatch.setattr(ann, "slices_for", lambda moved, held: 3)
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist(), "s") for i, v in enumerate(rng.standard_normal((700, 12)).astype(np.float32))]
    got, expected = found(spark, rows + rows[:60]), brute([r[:2] for r in rows])
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert got.keys() == expected.keys() and hits / (5 * len(expected)) >= 0.9
    assert all(len(g) == 5 for g in got.values())
    assert steps[:3] == [(range(0, 2),), (range(2, 4),), (range(4, 6),)] and steps[3:6] == [(3, 0), (3, 1), (3, 2)]
    left = [tag for tag, path in made if os.path.exists(path.removeprefix("file:"))]
    assert left.count("graph") == 1 and left.count("search") == 0 and left.count("near") == 3


def test_slices_follow_the_table():
    """However large the table, no step moves more than half of it at once."""
    for count in (10_000, 10**6, 10**8):
        moved = count * (ann.K + ann.BACK) * 272
        assert moved / ann.slices_for(moved, count * 272) <= max(ann.MOVED, count * 136)
    assert ann.slices_for(10**6, 10**5) == 1
