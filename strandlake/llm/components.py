"""Connected components by alternating large and small stars, all in DataFrames.

Every step is a map-side combined minimum for each node and a join; edges are written to the
shared folder after each round.  Nothing is gathered on the driver but a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import drop_folder, stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """For each node its least neighbour m (itself included); its larger (or smaller) neighbours are tied to m."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        tied = edges.join(least, "a")
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``node, component`` (least node) of all nodes with an edge, from ``a, b`` (any direction, repeats allowed)."""
    spark = edges.sparkSession
    now = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        new = stage(_star(_star(now, True), False), "edges")
        mark = tuple(new.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
        drop_folder(spark, now.staged_at)
        now = new
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
