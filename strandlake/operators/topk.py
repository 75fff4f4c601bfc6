"""Strongest members of a row's family: top-k by magnitude, gains and losses, gates, quotas, rendering.

Members are structs ``idx, value`` (and ``ref``); ties always go to the lowest index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.common import clean, small


def members(values: Column, refs: Column | None = None) -> Column:
    """Array of (idx, value, ref) of the values that are there (NaN is missing)."""
    ref = (lambda i: F.get(refs, i)) if refs is not None else (lambda i: F.lit(None).cast("double"))
    made = F.transform(values, lambda x, i: F.struct(i.cast("int").alias("idx"), clean(x.cast("double")).alias("value"), ref(i).cast("double").alias("ref")))
    return F.filter(made, lambda s: s["value"].isNotNull())


def _best(found: Column, key, k: int) -> Column:
    """The first k by (key, idx), ascending."""
    ranked = F.transform(found, lambda s: F.struct(key(s).alias("k"), s["idx"].alias("i"), s.alias("s")))
    return F.transform(F.slice(F.array_sort(ranked), 1, k), lambda x: x["s"])


def top_abs(found: Column, k: int) -> Column:
    return _best(found, lambda s: -F.abs(s["value"]), k)


def top_gains(found: Column, k: int, least: float = 0.01) -> Column:
    return _best(F.filter(found, lambda s: s["value"] > least), lambda s: -s["value"], k)


def top_losses(found: Column, k: int, least: float = 0.01) -> Column:
    return _best(F.filter(found, lambda s: s["value"] < -least), lambda s: s["value"], k)


def render(top: Column, names: list[str], digits: int = 3) -> Column:
    """``name=0.123(ref=0.456); ...``, without the parenthesis where the reference is missing; ``None`` if empty."""
    label = F.array(*[F.lit(n) for n in names])
    form = f"%.{digits}f"
    text = F.transform(top, lambda s: F.concat(F.element_at(label, s["idx"] + 1), F.lit("="), F.format_string(form, s["value"]), F.when(s["ref"].isNotNull(), F.concat(F.lit("(ref="), F.format_string(form, s["ref"]), F.lit(")"))).otherwise("")))
    return F.when(F.size(top) > 0, F.array_join(text, "; ")).otherwise("None")


def parse_rendered(text: Column) -> Column:
    """The rendered form taken apart again: array of (name, value, ref)."""
    parts = F.when(text.isNull() | (text == "None"), F.array().cast("array<string>")).otherwise(F.split(text, "; "))
    number = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    return F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("name"), F.expr("try_cast(null as double)").alias("none"), F.regexp_extract(p, f"={number}", 1).try_cast("double").alias("value"), F.regexp_extract(p, rf"\(ref={number}\)", 1).try_cast("double").alias("ref")).dropFields("none"))


def kept_statistics(top: Column, names: list[str]) -> Column:
    """Struct of the map name -> value of the kept members and their mean, median, least and greatest."""
    label = F.array(*[F.lit(n) for n in names])
    v = F.array_sort(F.transform(top, lambda s: s["value"]))
    n = F.size(v)
    mid = (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2
    return F.struct(
        F.map_from_entries(F.transform(top, lambda s: F.struct(F.element_at(label, s["idx"] + 1), s["value"]))).alias("kept"),
        F.when(n > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n).alias("mean"),
        F.when(n > 0, mid).alias("median"),
        F.array_min(v).alias("least"),
        F.array_max(v).alias("greatest"),
    )


def gate(long: DataFrame, thresholds: DataFrame, mode: str, eps: float = 0.0, reference: str = "benign", stat: str = "std") -> DataFrame:
    """Rows of ``track, value`` that pass their track's limits; a track without limits never passes.

    ``mode``: ``abs`` (beyond the larger of |lo| and |hi|), ``gain`` (above hi) or ``loss`` (below lo).
    """
    limits = thresholds.filter((F.col("reference") == reference) & (F.col("stat") == stat)).select("track", F.col("lo").alias("__lo"), F.col("hi").alias("__hi"))
    joined = long.join(small(limits), "track")
    v = F.col("value")
    passes = {
        "abs": (F.abs(v) > eps) & (F.abs(v) > F.greatest(F.abs("__lo"), F.abs("__hi"))),
        "gain": (v > eps) & (v > F.col("__hi")),
        "loss": (v < -eps) & (v < F.col("__lo")),
    }[mode]
    return joined.filter(passes).drop("__lo", "__hi")


def ranked_tracks(long: DataFrame, key: str) -> DataFrame:
    """All families together: ``rank`` by magnitude in each row, and ``alt = ref + value``.  ``long``: key, source, idx, value, ref."""
    w = Window.partitionBy(key).orderBy(F.desc(F.abs("value")), "source", "idx")
    return long.filter("value is not null").withColumn("rank", F.row_number().over(w)).withColumn("alt", F.col("ref") + F.col("value"))


def quota_top(long: DataFrame, key: str, n: int, source: str, quota: int) -> DataFrame:
    """The n strongest of each row, of which at least ``quota`` (if there are so many) come from ``source``."""
    strong = [F.desc(F.abs("value")), "source", "idx"]
    own = F.row_number().over(Window.partitionBy(key, "source").orderBy(*strong))
    rows = long.filter("value is not null").withColumn("__own", own).withColumn("__must", (F.col("source") == source) & (F.col("__own") <= quota))
    w = Window.partitionBy(key).orderBy(F.desc("__must"), *strong)
    return rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*strong))).drop("__own", "__must", "__r")


def summary_signals(long: DataFrame, key: str, least: float = 0.03, per_source: int = 5) -> DataFrame:
    w = Window.partitionBy(key, "source").orderBy(F.desc(F.abs("value")), "idx")
    return long.filter(F.abs("value") >= least).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_source)


def distinct_names(ranked: DataFrame, key: str, name: str, rank: str = "rank") -> DataFrame:
    """Repeated names within a row become ``name [1]``, ``name [2]``, ... in order of rank."""
    w = Window.partitionBy(key, name)
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy(rank))
    return ranked.withColumn(name, F.when(n > 1, F.concat(F.col(name), F.lit(" ["), i.cast("string"), F.lit("]"))).otherwise(F.col(name)))


def window_extremes(values: Column, first_offset: int) -> Column:
    """Greatest rise and drop over window offsets and where (lowest offset of ties); no rise or drop has no place."""
    placed = F.transform(values, lambda x, i: F.struct(x.alias("v"), (-i).alias("r")))
    there = F.filter(placed, lambda s: s["v"].isNotNull())
    up = F.array_max(there)
    down = F.array_max(F.transform(there, lambda s: F.struct((-s["v"]).alias("v"), s["r"].alias("r"))))
    return F.struct(
        F.greatest(up["v"], F.lit(0.0)).alias("gain"),
        F.when(up["v"] > 0, first_offset - up["r"]).alias("gain_pos"),
        F.greatest(down["v"], F.lit(0.0)).alias("loss"),
        F.when(down["v"] > 0, first_offset - down["r"]).alias("loss_pos"),
    )
