"""Scores against a reference class: group z-scores, frozen backgrounds and other scalings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.common import small
from strandlake.operators.families import to_long
from strandlake.operators.running import exact_quantiles


def reference_moments(df: DataFrame, group: str, array: str, is_reference: Column, min_rows: int = 10, floor: float = 1e-8) -> DataFrame:
    """``group, mu, sigma``: arrays of mean and population deviation of the reference rows of each group.

    A group with fewer than ``min_rows`` reference rows takes those of all groups; a deviation
    below ``floor`` (or missing) counts as 1.
    """
    long = to_long(df.select(F.col(group).alias("g"), is_reference.alias("r"), array), ["g", "r"], array)
    own = long.groupBy("g", "idx").agg(F.count_if("r").alias("n"), F.avg(F.when(F.col("r"), F.col("value"))).alias("m"), F.stddev_pop(F.when(F.col("r"), F.col("value"))).alias("s"))
    pooled = long.filter("r").groupBy("idx").agg(F.avg("value").alias("pm"), F.stddev_pop("value").alias("ps"))
    both = own.join(small(pooled), "idx", "left")
    few = F.col("n") < min_rows
    sigma = F.when(few, F.col("ps")).otherwise(F.col("s"))
    both = both.select("g", "idx", F.when(few, F.col("pm")).otherwise(F.col("m")).alias("m"), F.when(sigma >= floor, sigma).otherwise(1.0).alias("s"))
    ordered = F.array_sort(F.collect_list(F.struct("idx", "m", "s")))  # as long as the family
    return both.groupBy("g").agg(ordered.alias("x")).select(F.col("g").alias(group), F.col("x.m").alias("mu"), F.col("x.s").alias("sigma"))


def apply_z(df: DataFrame, group: str, array: str, moments: DataFrame, out: str = "z") -> DataFrame:
    """``df`` with the array ``out`` of (x - mu) / sigma; missing values give 0."""
    m = moments.withColumnRenamed(group, "__g")
    joined = df.join(small(m), df[group].eqNullSafe(F.col("__g")), "left")
    z = F.transform(F.arrays_zip(F.col(array).alias("x"), F.col("mu").alias("m"), F.col("sigma").alias("s")), lambda t: F.coalesce((t["x"] - t["m"]) / t["s"], F.lit(0.0)))
    return joined.withColumn(out, z).drop("__g", "mu", "sigma")


def freeze_background(moments: DataFrame, group: str, names: list[str]) -> DataFrame:
    """The moments as a table ``variant_type, delta_col, mean, std``."""
    rows = moments.select(F.col(group).alias("variant_type"), F.posexplode(F.arrays_zip("mu", "sigma")).alias("idx", "x"))
    return rows.select("variant_type", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("idx") + 1).alias("delta_col"), F.col("x.mu").alias("mean"), F.col("x.sigma").alias("std"))


def thaw_background(background: DataFrame, group: str, names: list[str], duplicate_policy: str = "last", order: str | None = None) -> DataFrame:
    """Moments from a frozen table.  Repeated (type, column) rows: the first or the last by ``order`` counts."""
    w = Window.partitionBy("variant_type", "delta_col").orderBy(F.col(order).asc() if duplicate_policy == "first" else F.col(order).desc()) if order else None
    rows = background.withColumn("__n", F.row_number().over(w)).filter("__n = 1") if w is not None else background
    idx = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("delta_col")) - 1
    ordered = F.array_sort(F.collect_list(F.struct(idx.alias("idx"), "mean", "std")))
    out = rows.filter(F.col("delta_col").isin(names)).groupBy("variant_type").agg(ordered.alias("x"))
    return out.select(F.col("variant_type").alias(group), F.col("x.mean").alias("mu"), F.col("x.std").alias("sigma"))


def groups_without_background(df: DataFrame, group: str, background: DataFrame) -> DataFrame:
    """Groups of ``df`` that the background lacks (must be empty for a frozen score)."""
    return df.select(F.col(group).alias("variant_type")).distinct().join(background.select("variant_type").distinct(), "variant_type", "left_anti")


def group_members(df: DataFrame, group: str, extra: dict[str, Column]) -> DataFrame:
    """One row for each group a row belongs to: its own ``group`` value and each name in ``extra`` whose condition holds."""
    names = F.array(F.col(group), *[F.when(c, F.lit(n)) for n, c in extra.items()])
    return df.withColumn("member_of", F.explode(F.filter(names, lambda x: x.isNotNull())))


def column_z(df: DataFrame, columns: list[str], sample: bool = True) -> DataFrame:
    """``<c>_z`` over the whole table (sample deviation); null where the deviation is 0.  Moments are one aggregate, joined back."""
    dev = F.stddev_samp if sample else F.stddev_pop
    moments = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[dev(c).alias(f"__s_{c}") for c in columns])
    out = df.join(F.broadcast(moments))  # one row
    return out.select(*df.columns, *[((F.col(c) - F.col(f"__m_{c}")) / F.nullif(F.col(f"__s_{c}"), F.lit(0.0))).alias(f"{c}_z") for c in columns])


def scale_by_reference_sd(df: DataFrame, array: str, is_reference: Column, floor: float = 1e-6, out: str = "scaled") -> DataFrame:
    """Divides by the population deviation of the reference rows, without centring."""
    m = reference_moments(df.withColumn("__all", F.lit(0)), "__all", array, is_reference, min_rows=0, floor=floor)
    joined = df.join(F.broadcast(m))  # one row
    return joined.withColumn(out, F.zip_with(array, "sigma", lambda x, s: x / s)).drop("__all", "mu", "sigma")


def mad_moments(df: DataFrame, array: str, is_reference: Column, floor: float = 1e-6) -> DataFrame:
    """``idx, med, mad`` of the reference rows (exact medians; a deviation below ``floor`` counts as 1)."""
    long = to_long(df.filter(is_reference).select(array), [], array)
    med = exact_quantiles(long, ["idx"], "value", [0.5]).select("idx", F.col("q")[0].alias("med"))
    distance = long.join(small(med), "idx").select("idx", F.abs(F.col("value") - F.col("med")).alias("away"))
    away = exact_quantiles(distance, ["idx"], "away", [0.5]).select("idx", F.col("q")[0].alias("mad"))
    return med.join(away, "idx").select("idx", "med", F.when(F.col("mad") >= floor, F.col("mad")).otherwise(1.0).alias("mad"))
