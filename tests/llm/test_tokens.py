import numpy as np

from quire.llm import tokens


def test_counts_match_the_encoder(spark):
    texts = ["one two", "", None, "<|endoftext|>", "é漢 " * 300, "same", "same"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(6, "same", "x")], "doc_id long, text string, nth string")
    encode = tokens.encoding(tokens.default_path()).encode_ordinary
    found = sorted((r["doc_id"], r["n_tokens"]) for r in tokens.token_counts(docs).collect())
    assert found == sorted([(i, len(encode(t or ""))) for i, t in enumerate(texts)] + [(6, 1)])
    assert tokens.token_counts(docs.limit(0)).count() == 0


def test_blocks_are_stitched(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "SPAN", 3)
    rng, rows, expected = np.random.default_rng(0), [], set()
    for name, n, tail in (("a", 400, True), ("b", 100, False), ("c", 0, False), ("d", 1, False)):
        ids = rng.choice([7, 8, 9], n).astype("<u2")
        if n > 1:
            ids[50:90] = 1  # a document over many blocks
        if n and not tail:
            ids[-1] = 9
        elif n:
            ids[-1] = 7
        path = tmp_path / name
        path.write_bytes(ids.tobytes())
        rows.append((f"file://{path}", 2 * n))
        start = nth = 0
        for i, t in enumerate(ids.tolist()):
            if t == 9:
                expected.add((f"file://{path}", nth, start, i - start, True))
                start, nth = i + 1, nth + 1
        if start < n:
            expected.add((f"file://{path}", nth, start, n - start, False))
    files = spark.createDataFrame(rows, "file string, file_bytes long")
    found = [tuple(r) for r in tokens.documents(files, separator=9, block=8).collect()]
    assert len(found) == len(expected) and set(found) == expected
