"""Counts, cross-tables, pivots and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.common import clean, small


def ordered_text(df: DataFrame, keys: list[str], text: str, order: list[str], separator: str = " | ", skip: tuple[str, ...] = ("-", "")) -> DataFrame:
    """For each key its distinct texts in order of first appearance, joined; blanks and placeholders are left out.

    Texts are made distinct (with their first place) before they are collected.
    """
    rows = df.withColumn("__t", F.trim(F.col(text))).filter(F.col("__t").isNotNull() & ~F.col("__t").isin(*skip))
    first = rows.groupBy(*keys, "__t").agg(F.min(F.struct(*order)).alias("__o"))
    gathered = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__o", "__t"))).alias("__x"))
    return gathered.select(*keys, F.array_join(F.col("__x.__t"), separator).alias(text))


def combined_rationale(description: Column, explanation: Column, missing: str = "No detailed rationale provided.") -> Column:
    parts = F.array_compact(F.array(F.when(F.length(description) > 0, F.concat(F.lit("DESC: "), description)), F.when(F.length(explanation) > 0, F.concat(F.lit("EXPL: "), explanation))))
    return F.when(F.size(parts) > 0, F.array_join(parts, "\n")).otherwise(F.lit(missing))


def value_counts(df: DataFrame, columns: list[str], dropna: bool = False) -> DataFrame:
    """``n`` and ``pct`` of all rows for each combination."""
    rows = df.dropna(subset=columns) if dropna else df
    counts = rows.groupBy(*columns).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(rows.agg(F.count("*").alias("__all")))).withColumn("pct", 100.0 * F.col("n") / F.col("__all")).drop("__all")


def conditional_counts(df: DataFrame, keys: list[str], conditions: dict[str, Column]) -> DataFrame:
    """``total`` and one count for each named condition (null counts as no); null groups are kept."""
    return df.groupBy(*keys).agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in conditions.items()])


def cross_table(df: DataFrame, row: str, column: str, rows: list, columns: list) -> DataFrame:
    """Counts in a fixed order of rows and columns, absent combinations as 0.  ``row, position``, one column for each value."""
    counts = df.filter(F.col(row).isin(rows) & F.col(column).isin(columns)).groupBy(row).pivot(column, columns).agg(F.count(F.lit(1)))
    order = df.sparkSession.createDataFrame([(i, r) for i, r in enumerate(rows)], f"position int, {row} {df.schema[row].dataType.simpleString()}")
    return F.broadcast(order).join(counts, row, "left").na.fill(0).select(row, "position", *[str(c) for c in columns])


def row_shares(table: DataFrame, row: str, columns: list[str], min_total: int = 0) -> DataFrame:
    """Rows of a cross-table as shares, with ``total``; rows with fewer than ``min_total`` samples go."""
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    out = table.withColumn("total", total).filter(F.col("total") >= max(1, min_total))
    return out.select(row, *[(F.col(c) / F.col("total")).alias(c) for c in columns], "total")


def pivot_sum(df: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    return df.groupBy(row).pivot(column, columns).agg(F.sum(value)).na.fill(0)


def review_status_ok(df: DataFrame, key: str, status: str, allowed: list[str], criteria: list[str], expert: str) -> DataFrame:
    """``key, n, passes``: a single record must be ``expert``; of several all must be allowed and one at least have criteria."""
    g = df.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col(status) == expert).alias("e"), F.count_if(F.col(status).isin(allowed)).alias("a"), F.count_if(F.col(status).isin(criteria)).alias("c"))
    return g.select(key, "n", F.when(F.col("n") == 1, F.col("e") == 1).otherwise((F.col("a") == F.col("n")) & (F.col("c") >= 1)).alias("passes"))


def accuracy_by(df: DataFrame, keys: list[str], right: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(right.cast("int")).alias("accuracy"))


def quadrants(df: DataFrame, x: str, y: str, x_cut: float, y_cut: float, positive: Column) -> DataFrame:
    """Counts and percentage of positives in the four fields of two cuts (at the cut counts as high)."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = rows.groupBy((F.col(x) >= x_cut).alias("x_high"), (F.col(y) >= y_cut).alias("y_high"))
    return g.agg(F.count("*").alias("n"), F.count_if(positive).alias("n_positive")).withColumn("pct_positive", 100.0 * F.col("n_positive") / F.col("n"))


def unpivoted(df: DataFrame, keep: list[str], columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    """``keep, name, value`` (double, NaN as null) for each column."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), clean(F.col(c).cast("double")).alias(value)) for c in columns])
    return df.select(*keep, F.explode(pairs).alias("__p")).select(*keep, f"__p.{name}", f"__p.{value}")


def column_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """``name, n, non_null, least, greatest, mean`` of each column."""
    return unpivoted(df, [], columns).groupBy("name").agg(F.count("*").alias("n"), F.count("value").alias("non_null"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.avg("value").alias("mean"))


def bounds_check(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """``name, non_null, violations, rate`` of values outside their limits."""
    rows = unpivoted(df, [], list(limits))
    inside = F.lit(True)
    for c, (low, high) in limits.items():
        inside = F.when(F.col("name") == c, F.col("value").between(low, high)).otherwise(inside)
    g = rows.groupBy("name").agg(F.count("value").alias("non_null"), F.count_if(F.col("value").isNotNull() & ~inside).alias("violations"))
    return g.withColumn("rate", F.try_divide(F.col("violations").cast("double"), F.col("non_null")))


def rank_by_magnitude(df: DataFrame, columns: list[str]) -> DataFrame:
    """``name, mean_abs, place`` of the columns by mean absolute value."""
    g = unpivoted(df, [], columns).groupBy("name").agg(F.avg(F.abs("value")).alias("mean_abs"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean_abs"), "name")))  # one row a column


def modal_share(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``mode`` (least of ties), ``share`` of rows with it, for each key; counted before any rank."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("c"))
    g = counts.groupBy(*keys).agg(F.sum("c").alias("n"), F.max("c").alias("top"))
    best = counts.join(g.select(*keys, "top", "n"), keys).filter("c = top").groupBy(*keys, "n", "top").agg(F.min(value).alias("mode"))
    return best.select(*keys, "mode", "n", (F.col("top") / F.col("n")).alias("share"))


def expected_minus_observed(df: DataFrame, column: str, expected: list) -> DataFrame:
    """Expected values that do not occur."""
    wanted = df.sparkSession.createDataFrame([(x,) for x in expected], f"{column} {df.schema[column].dataType.simpleString()}")
    return wanted.join(small(df.select(column).distinct()), column, "left_anti")


def funnel(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """``step, position, n``: rows left after each condition and all before it, in one pass."""
    so_far, counts = F.lit(True), [F.count("*").alias("all")]
    for name, condition in steps.items():
        so_far = so_far & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(so_far).alias(name))
    names = ["all", *steps]
    one = df.agg(*counts)
    return one.select(F.posexplode(F.array(*[F.struct(F.lit(n).alias("step"), F.col(n).alias("n")) for n in names])).alias("position", "x")).select("position", "x.step", "x.n")
