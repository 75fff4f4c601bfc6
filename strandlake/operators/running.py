"""Running sums and exact quantiles over ordered values, in two levels instead of one task.

Values are dealt by range and written once with the sum of each part; running sums are
formed inside the parts, and the sums of the parts before give the offsets.  No key, however
hot, needs a task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.common import all_of, clean
from strandlake.storage import stage


def running_sums(df: DataFrame, keys: list[str], value: str, columns: list[str]) -> DataFrame:
    """``df`` (one row for each key and value) with ``upto_<c>`` - the sum over values up to this one - and ``all_<c>`` of each key."""
    order = [*keys, value]
    ranged = df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    rows = stage(ranged, "running")
    inside = Window.partitionBy("__p", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", *[F.sum(c).over(inside).alias(f"upto_{c}") for c in columns])
    parts = rows.groupBy(*keys, "__p").agg(*[F.sum(c).alias(f"__s_{c}") for c in columns])  # a row for each part and key in it
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = whole.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__p").alias("__q"),
        *[F.coalesce(F.sum(f"__s_{c}").over(before), F.lit(0)).alias(f"__o_{c}") for c in columns], *[F.sum(f"__s_{c}").over(whole).alias(f"all_{c}") for c in columns],
    )
    same = all_of([F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]) & (F.col("__p") == F.col("__q"))
    out = local.join(offsets, same).withColumns({f"upto_{c}": F.col(f"upto_{c}") + F.col(f"__o_{c}") for c in columns})
    return out.select(*df.columns, *[f"upto_{c}" for c in columns], *[f"all_{c}" for c in columns])


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """``keys, n, q``: the interpolated quantiles of each key as an array in the order of ``shares``; missing values are left out.

    Values are counted first, so what is dealt out is one row for each distinct value.
    """
    x = clean(F.col(value).cast("double"))
    counts = df.select(*keys, x.alias("__x")).filter("__x is not null").groupBy(*keys, "__x").agg(F.count("*").alias("c"))
    run = running_sums(counts, keys, "__x", ["c"])

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("upto_c") - F.col("c") <= rank) & (rank < F.col("upto_c")), F.col("__x")))

    picks, out = [], []
    for i, s in enumerate(shares):
        place = F.lit(float(s)) * (F.col("all_c") - 1)
        picks += [at(F.floor(place)).alias(f"__l{i}"), at(F.ceil(place)).alias(f"__h{i}")]
        whole = F.lit(float(s)) * (F.col("n") - 1)
        out.append(F.col(f"__l{i}") + (F.col(f"__h{i}") - F.col(f"__l{i}")) * (whole - F.floor(whole)))
    n = F.max("all_c").alias("n")
    g = run.groupBy(*keys).agg(n, *picks) if keys else run.agg(n, *picks)
    return g.select(*keys, "n", F.array(*out).alias("q"))
