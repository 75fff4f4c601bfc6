"""Registered queries of the analytics operators and their DuckDB equivalents.

The SQL is written independently of the Spark plan wherever there is another way (pair
counting for rank statistics, unnesting for arrays, plain range predicates for bins).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function ``(spark, sf_dir) -> DataFrame`` under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    from strandlake.plans import relational, scores, statistics, strings, variants  # noqa: F401


_load()
