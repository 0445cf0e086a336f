import math

import pytest
from pyspark.sql import functions as F

from quire.operators import layout


def test_plain():
    assert layout.bio_labels(["question", "other", "answer"]) == {"O": 0, "B-QUESTION": 1, "I-QUESTION": 2, "B-ANSWER": 3, "I-ANSWER": 4}
    assert layout.word_rate("a b c", "a b c") == 1 and layout.word_rate("a b", "") == 0 and layout.word_rate("", "") == 1
    assert layout.psnr([0, 0], [0, 0]) == math.inf and layout.psnr([255.0], [0.0]) == 0


def test_chunks_and_padding(spark):
    df = spark.createDataFrame([(1, list(range(5))), (2, [])], "id int, t array<int>")
    assert sorted((r["id"], r["start"], r["chunk"]) for r in layout.token_chunks(df, "t", 2).collect()) == [(1, 0, [0, 1]), (1, 2, [2, 3]), (1, 4, [4]), (2, 0, [])]
    chunks = layout.token_chunks(df, "t", 2, first_only=True)
    entities = spark.createDataFrame([(1, 0, 1, "A"), (1, 1, 2, "B")], "id int, first int, last int, label string")
    assert [tuple(r) for r in layout.chunk_entities(chunks, entities, "id", 2).select("label", "first", "last").collect()] == [("A", 0, 1)]
    tokens, mask = layout.padded(F.array(F.lit(7), F.lit(8)), 4)
    row = spark.range(1).select(tokens.alias("t"), mask.alias("m")).first()
    assert (row["t"], row["m"]) == ([7, 8, 0, 0], [1, 1, 0, 0])


def test_bilingual(spark):
    a = spark.createDataFrame([(1, "سلام", 0.9), (2, "", 0.1), (3, "ab", 0.2), (4, " ", 0.1)], "line_no int, text string, score double")
    b = spark.createDataFrame([(1, "Hello سلام", 0.8), (2, "Latin", 0.7), (3, "xyz", 0.6), (5, "new", 0.9)], "line_no int, text string, score double")
    found = {r["line_no"]: r["text"] for r in layout.merge_bilingual(a, b).collect()}
    assert found == {1: "سلام Hello", 2: "Latin", 3: "xyz", 5: "new"}


def test_too_many_tiles(spark):
    from pyspark.errors import PySparkException

    df = spark.createDataFrame([(9000, 9000)], "w int, h int")
    assert layout.tiles(df, "w", "h", 4000, 4000).count() == 9
    with pytest.raises(PySparkException):
        layout.tiles(df, "w", "h", 100, 100).count()
