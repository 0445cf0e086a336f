import random

import numpy as np
import pytest

from quire.llm import common
from quire.llm import decontaminate as d


def brute_score(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            rows[i + 1][j + 1] = max(0, rows[i][j] + (d.MATCH if a[i] == b[j] else d.MISMATCH), rows[i][j + 1] + d.GAP, rows[i + 1][j] + d.GAP)
    return max(map(max, rows))


def test_alignment_scores():
    rng = random.Random(1)
    for _ in range(300):
        a, b = (np.array(rng.choices(range(4), k=rng.randint(0, 12)), np.int32) for _ in range(2))
        score, matched, start, end = d.align(a, b)
        assert score == (brute_score(a.tolist(), b.tolist()) if len(a) and len(b) else 0)
        assert brute_score(a.tolist(), b[start:end].tolist()) == score and matched <= end - start


def test_planted_copies_are_found_and_clean_texts_are_not(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)] + ["the", "of", "and"] * 60
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(20, 40)))) for i in range(8)] + [(90, None), (91, "two words"), (92, "")]
    around = lambda: " ".join(rng.choices(vocabulary, k=60))
    rows, expected = [], set()
    for k in range(120):
        i = k % 8
        words = items[i][1].split()
        if k % 4 == 1:
            words = [w if n % 6 else "zzz" for n, w in enumerate(words)]  # edited
        elif k % 4 == 2:
            words = [w for n, w in enumerate(words) if n % 7]  # shortened
        if k % 4 == 3:
            rows.append((k, around()))
        else:
            rows.append((k, f"{around()}\n{' '.join(words).upper()}, {around()}"))
            expected.add((k, i))
    docs = spark.createDataFrame([*rows, (500, None), (501, ""), (None, items[0][1])], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = d.contaminated(docs, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == expected | {(None, 0)}
    kept = d.drop_contaminated(docs.withColumnRenamed("doc_id", "copies"), benchmark)
    assert {r["copies"] for r in kept.collect()} == {r[0] for r in rows} - {k for k, _ in expected} | {500, 501}
    assert d.contaminated(docs.limit(0), benchmark).count() == 0
    assert d.contaminated(docs, benchmark.limit(0)).count() == 0 and d.drop_contaminated(docs, benchmark.limit(0)).count() == docs.count()


def test_a_salted_join_gives_the_same(spark, sf, monkeypatch):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = {tuple(r) for r in d.contaminated(docs, items).collect()}
    monkeypatch.setattr(common, "SMALL", -1)
    assert {tuple(r) for r in d.contaminated(docs, items).collect()} == whole
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    exact = {(i, b["item_id"]) for i, t in texts.items() for b in items.collect() if b["text"] in t}
    assert exact and exact <= {r[:2] for r in whole}


def brute_pairs(docs, items):
    """All pairs by whole alignments."""
    items = [(i, d.hashes_of(t.encode())) for i, t in items]
    out = set()
    for k, text in docs:
        words = d.hashes_of(text.encode())
        for i, item in items:
            score, matched, _, _ = d.align(item, words)
            if score >= d.MATCH * d.least_score(len(item)) and matched >= min(d.LEAST, len(item)):
                out.add((k, i))
    return out


@pytest.mark.parametrize("common_words", [0, 30])
def test_edited_copies_against_all_pairs_of_alignments(spark, common_words):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghijklm", k=rng.randint(3, 8))) for _ in range(3000)] + ["the", "of", "and", "to"] * common_words
    items = [(i, " ".join(rng.choices(vocabulary, k=30))) for i in range(40)]
    edits = [lambda n, k=k: n % k == k - 1 for k in (3, 4, 5)] + [lambda n, s=s: rng.random() < s for s in (0.1, 0.15, 0.2, 0.25, 0.3)]
    docs = []
    for edit in edits:
        for i, text in items:
            words = [rng.choice(vocabulary) if edit(n) else w for n, w in enumerate(text.split())]
            docs.append((len(docs), " ".join([*rng.choices(vocabulary, k=40), *words, *rng.choices(vocabulary, k=40)])))
    expected = brute_pairs(docs, items)
    found = {(r["doc_id"], r["item_id"]) for r in d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found <= expected and len(expected) > 300
    assert len(found) >= 0.99 * len(expected)


def test_very_long_items_and_passages(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(5000)]
    long = rng.choices(vocabulary, k=20_000)
    docs = [(1, " ".join(rng.choices(vocabulary, k=30_000) + long[7000:7060] + rng.choices(vocabulary, k=3000))), (2, " ".join(rng.choices(vocabulary, k=5000)))]
    found = d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(5, " ".join(long))], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["start"], r["end"], r["matched"]) for r in found] == [(1, 30_000, 30_060, 60)]


def test_words_and_their_hashes():
    assert d.words_of("Ça va—«très» bien_or 東京 x".encode()) == ["ça".encode(), b"va", "très".encode(), b"bien", b"or", "東".encode(), "京".encode(), b"x"]
    rng = random.Random(7)
    texts = [" ".join(rng.choices(["a", "ab", "ba", "b", "Äb", "c-d", "\n", "A"], k=rng.randint(0, 50))).encode() for _ in range(200)]
    seen = {}
    for t in [*texts, b"", b" ", b"x" * 300, b"y z " * 700_000]:
        words, hashes = d.words_of(t), d.hashes_of(t).tolist()
        assert len(words) == len(hashes)
        for w, h in zip(words, hashes):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_repeats_ties_and_clashing_names(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, f"x {item} y {item}", 5, 6), (1, f"x {item} y {item}", 5, 6), (2, "one two six seven x y z", 1, 1), (3, None, 2, 2), (4, "", 2, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_hash int, row int")
    items = spark.createDataFrame([(1, item), (1, item), (2, item.upper()), (3, "ten nine"), (None, "five five five five")], "item_id long, text string")
    found = sorted(tuple(r) for r in d.contaminated(docs, items).collect())
    assert found == [(1, 1, 1.0, 10, 1, 11)] * 2 + [(1, 2, 1.0, 10, 1, 11)] * 2
    kept = d.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]
