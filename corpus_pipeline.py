"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, decontaminate, quality, simhash, toxicity
from quire.llm.common import small_batches, table, written


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def frugal(stage: Stage) -> Stage:
    """A stage that runs, as all after it, with small Arrow batches."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@frugal
def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled rows of sf_dir outside its held fold."""
    model = quality.train(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


@frugal
def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier accepts; it learns from the labelled rows of sf_dir outside its held fold."""
    model = toxicity.train(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


@frugal
def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose shingles of five words have a similarity of 0.8 or more, the one with the smallest id."""
    return simhash.keep_one(docs)


@frugal
def fair(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without copies of benchmark items."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


@frugal
def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their ids (little-endian unsigned 32-bit integers), the text that these decode to, and their count."""
    return bpe.encode(docs).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", good),
    ("toxicity", clean),
    ("near duplicates", distinct),
    ("benchmark", fair),
    ("tokens", tokenised),
]

#: The classifiers and the tokenizer can't be said in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = written(docs, f"stage{number}")
    return docs
