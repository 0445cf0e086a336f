import random
import re

import pytest
import xxhash

from quire.llm import simhash


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits):
    ids = {}
    for i, fp in prints:
        ids.setdefault(i, fp)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if label[b] < label[a] and (ids[a] ^ ids[b]).bit_count() <= bits:
                    label[a], changed = label[b], True
    return label


def test_fingerprints(spark):
    rng = random.Random(0)
    texts = [None, "", " \t\n", "One", "one two", "A b C", "É é x", "x " * 4000, "w\x1cv u t", *[" ".join(rng.choices("a b c d e f".split(), k=rng.randint(1, 40))) for _ in range(30)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["fp"] % (1 << 64) for r in simhash.near_duplicates(docs).collect()}
    assert found == {i: brute_print(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("bits", [1, 2])
@pytest.mark.parametrize("longest", [2, 32])
def test_components_of_links(spark, monkeypatch, bits, longest):
    monkeypatch.setattr(simhash, "LIST", longest)
    rng = random.Random(bits * 10 + longest)
    prints = []
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 25])):
            fp = base
            for _ in range(rng.randint(0, 5)):
                fp ^= 1 << rng.randrange(64)
            prints.append(fp)
    rows = list(enumerate(dict.fromkeys(prints)))
    signed = [(i, fp - (1 << 64) if fp >> 63 else fp) for i, fp in rows]
    edges = simhash.links(spark.createDataFrame(signed, "rep long, fp long"), bits)
    got = {r["node"]: r["component"] for r in simhash.connected_components(edges).collect()}
    expected = brute_components(rows, bits)
    assert {i: got.get(i, i) for i, _ in rows} == expected


def test_edge_cases_of_links(spark):
    docs = spark.createDataFrame([(5, "a b c d", 1), (3, "A b c  d", 2), (3, "A b c  d", 2), (9, "quite another text", 3), (None, "a b c d", 4), (7, None, 5), (8, "", 6)], "doc_id long, text string, fp int")
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == 7 and sorted(str(r["component_id"]) for r in found) == ["3", "3", "3", "7", "7", "9", "None"]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_keeping_one_and_edge_cases(spark):
    rows = [(5, "a b c d", 1), (3, "A b c  d", 2), (3, "A b c  d", 2), (3, "of the same id but not like it", 3), (9, "quite another text", 3), (None, "a b c d", 4), (7, None, 5), (8, "", 6), (10, "x " * 50_000, 7), (11, "x " * 40_000, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_class int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text_class"]) for r in kept.collect()) == [("10", 7), ("3", 2), ("3", 3), ("7", 5), ("9", 3), ("None", 4)]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_similar_texts_against_all_pairs(spark):
    rng = random.Random(0)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for _ in range(60):
        base = rng.choices(words, k=rng.randint(30, 400))
        for _ in range(rng.randint(1, 4)):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append(" ".join(text))
    crowd = rng.choices(words, k=200)
    rows += [" ".join(crowd[:i] + ["new"] + crowd[i + 1 :]) for i in range(0, 200, 2)]
    rows += ["", "\t", "one two", "One  two", "three"]
    sets = [shingles(t) for t in rows]
    least, links, changed = list(range(len(rows))), 0, True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(len(rows)):
                if least[b] < least[a] and (10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])):
                    least[a], changed = least[b], True
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert kept >= set(least)  # no clean document goes
    assert len(kept) - len(set(least)) <= 0.02 * (len(rows) - len(set(least)))


def linked(sets, pairs):
    """The least place that links of the pairs lead to, for each place."""
    least, changed = list(range(len(sets))), True
    links = [(a, b) for a, b in pairs if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    return least


@pytest.mark.parametrize("members", [1024, 40])
def test_crowds_form_no_pairs(spark, monkeypatch, members):
    """Texts that share much, though most of them less than 0.8: rows of pairs in proportion to them, and every link."""
    monkeypatch.setattr(simhash, "MEMBERS", members)
    rng, words = random.Random(7), [f"w{i}" for i in range(3000)]
    base = rng.choices(words, k=150)
    texts = []
    for n in range(150):
        text = list(base)
        for at in rng.sample(range(150), 1 + n % 5):
            text[at] = rng.choice(words)
        texts.append(" ".join(text))
    texts += [" ".join(rng.choices(words, k=60)) for _ in range(20)]
    sets, rows, write = [shingles(t) for t in texts], {}, simhash.written

    def counted(df, tag):
        out = write(df, tag)
        rows[tag] = rows.get(tag, 0) + out.count()
        return out

    monkeypatch.setattr(simhash, "written", counted)
    found = {r["doc_id"]: r["component"] for r in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows["crowds"] >= 100 and rows["pairs"] <= 4 * len(texts)
    groups = {}
    for i, c in found.items():
        groups.setdefault(c, []).append(i)
    expected = linked(sets, [(a, b) for a in range(len(sets)) for b in range(a)])
    assert {i: min(g) for g in groups.values() for i in g} == dict(enumerate(expected))
    assert 30 < len(set(expected)) < 150


def test_forest_against_all_pairs():
    import numpy as np

    rng = random.Random(2)
    for _ in range(40):
        sets = [frozenset(rng.sample(range(12), rng.randint(1, 12))) for _ in range(rng.randint(2, 25))]
        arrays = [np.array(sorted(s), np.uint64) for s in sets]
        cut = rng.randint(1, len(sets) - 1)
        for left, right in ((range(len(sets)),) * 2, (range(cut), range(cut, len(sets)))):
            edges = simhash.forest_of(np.arange(len(sets)), arrays, np.array(left), np.array(right))
            assert len(edges) < len(sets) and all(10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) for a, b in edges)
            assert linked(sets, edges) == linked(sets, [(a, b) for a in left for b in right])


def test_lists_over_batches(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(40), i) for i in range(300)] + [(1000 + i, i) for i in range(50)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = {tuple(r) for r in simhash._lists(spark.createDataFrame(rows, "key long, node long")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    lists = {}
    for k, v in rows:
        lists.setdefault(k, []).append(v)
    assert found == {(k, min(v), x) for k, v in lists.items() if len(v) > 1 for x in v}


def test_sketches_agree_as_often_as_similar(spark):
    """Keys shared by pairs of similarity 0.8: three bytes of bits that agree by 1 - angle / pi."""
    import numpy as np

    rng, shared = np.random.default_rng(3), []
    for _ in range(200):
        common = rng.integers(0, 1 << 63, 160, np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 1 << 63, 20, np.uint64)]) for _ in range(2))  # 160 of 200
        x, y = simhash.keys_of([a, b])
        shared.append(int((x == y).sum()))
    assert abs(np.mean(shared) - 6.6) < 0.8 and np.mean(np.array(shared) >= 2) > 0.97
