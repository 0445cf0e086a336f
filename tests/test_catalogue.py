import math

import duckdb
import pytest

from quire.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_equal_to_sql(spark, oracle, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rows = oracle.execute(catalogue.ORACLE[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert found == sorted((tuple(plain(r[i]) for i in at) for r in rows.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["script_text", "word_groups", "tokenize_13a", "word_edit", "html_blocks", "markdown_render", "teds"])
def test_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
