"""Where queries and their statements for DuckDB are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meterlake.sources.facade import view

TODAY, MONTH, USER, START, END = "2024-01-20", "2024-01-01", "u7", "2024-01-10", "2024-02-05"
NOW = "2024-01-15T12:00:00.000Z"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle.strip()
        return fn

    return add


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [view(spark, sf_dir, n) for n in names]
