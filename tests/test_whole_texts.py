import random

import pytest

from quire.functions import text
from quire.plans import catalogue

TEXT = "alpha beta gamma delta " * 60 + "omega"


@pytest.fixture
def made(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(1, TEXT, "en")], "doc_id long, text string, lang string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 0, TEXT), (1, 1, TEXT)], "conv_id long, turn int, text string").write.parquet(f"{d}/conversations.parquet")
    return d


@pytest.mark.parametrize("name, column", [("script_text", "squeezed"), ("word_groups", "words"), ("tokenize_13a", "tokens"), ("bilingual_merge", "text")])
def test_last_word_is_there(spark, made, name, column):
    rows = catalogue.QUERIES[name](spark, made).collect()
    assert rows and all("omega" in str(r[column]) for r in rows)


def test_word_edit_counts_the_whole_text(spark, tmp_path):
    spark.createDataFrame([(3, TEXT, "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    # alpha and delta are misread, 60 times each.
    assert catalogue.QUERIES["word_edit"](spark, str(tmp_path)).first()["edits"] == 120


def test_edit_distance_by_its_table():
    rng = random.Random(0)
    for _ in range(300):
        a, b = (rng.choices("abcd", k=rng.randint(0, 90)) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        assert text.edit_distance(a, b) == row[-1]
