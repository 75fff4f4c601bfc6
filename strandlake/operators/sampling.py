"""Deterministic sampling by hash order: the same rows whatever the partitioning, and in any engine that has MD5."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _mark(key: str, seed: int):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def by_hash(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in the order of a hash of their key."""
    return df.withColumn("__h", _mark(key, seed)).orderBy("__h", key).limit(n).drop("__h")


def stratified(df: DataFrame, strata: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """Up to ``n`` rows of each stratum, by hash order.

    A salted first cut keeps ``n`` rows of each part of a stratum, so a hot stratum is never sorted in one task.
    """
    h = _mark(key, seed)
    rows = df.withColumn("__h", h).withColumn("__salt", F.pmod(F.hash(key), F.lit(64)))
    first = Window.partitionBy(*strata, "__salt").orderBy("__h", key)
    second = Window.partitionBy(*strata).orderBy("__h", key)
    cut = rows.withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= n)
    return cut.withColumn("__n", F.row_number().over(second)).filter(F.col("__n") <= n).drop("__n", "__h", "__salt")
