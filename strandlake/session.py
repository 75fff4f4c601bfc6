"""The session this library expects: ANSI on, UTC, adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "strandlake", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings that results depend on; sizes stay with the cluster unless given."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
