"""The registry of queries and of the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function under its own name, with its SQL if it has one."""
    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        if function.__name__ in QUERIES:
            raise ValueError(f"query {function.__name__} is there already")
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return add
