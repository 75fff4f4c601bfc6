"""Keyed joins, deduplication, set operations and table differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.common import all_of, small
from strandlake.storage import stage


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key (null keys are keys): the first by ``order``.

    The optimiser turns the filter on the row number into a group limit before the shuffle, so
    a task sends one row for each of its keys at most, however hot a key is (a test holds the plan to that).
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return keep_first(df, keys, [F.col(c).desc() for c in order])


def drop_repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Only rows whose key occurs once; all copies of other keys go.  Counted by key, then joined: no window over a hot key."""
    once = df.groupBy(*keys).agg(F.count("*").alias("__c")).filter("__c = 1").drop("__c")
    once = once.select(*[F.col(k).alias(f"__{k}") for k in keys])
    return df.join(once, all_of([df[k].eqNullSafe(F.col(f"__{k}")) for k in keys]), "left_semi")


def left_lookup(df: DataFrame, table: DataFrame, keys: list[str], columns: dict[str, Column | None], order: list[Column]) -> DataFrame:
    """Left join to the first row of each key of ``table``; ``columns`` maps its columns to defaults.

    The number of rows cannot change, whatever the table holds.
    """
    one = keep_first(table.dropna(subset=keys), keys, order).select(*keys, *columns)
    out = df.join(small(one), keys, "left")
    for c, default in columns.items():
        if default is not None:
            out = out.withColumn(c, F.coalesce(F.col(c), default))
    return out


def assert_same_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """``after``; raises if a join changed the number of rows."""
    a, b = before.count(), after.count()
    if a != b:
        raise ValueError(f"the join changed the number of rows: {a} before, {b} after")
    return after


def common_keys(left: DataFrame, right: DataFrame, wanted: list[str]) -> list[str]:
    return [k for k in wanted if k in left.columns and k in right.columns]


def join_on_common(left: DataFrame, right: DataFrame, wanted: list[str], how: str = "left") -> DataFrame:
    """Join on those of the ``wanted`` keys that both sides have; an error if there is none."""
    keys = common_keys(left, right, wanted)
    if not keys:
        raise ValueError(f"none of {wanted} is in both tables")
    return left.join(right, keys, how)


def suffixed_join(left: DataFrame, right: DataFrame, keys: list[str], suffix: str, fill: dict[str, Column] | None = None, how: str = "left") -> DataFrame:
    """Join in which columns on both sides are kept side by side, the right one named with ``suffix``; ``fill`` gives columns a default."""
    both = {c for c in right.columns if c in left.columns and c not in keys}
    out = left.join(right.select(*keys, *[F.col(c).alias(c + suffix) if c in both else F.col(c) for c in right.columns if c not in keys]), keys, how)
    return out.withColumns({c: F.coalesce(F.col(c), v) for c, v in (fill or {}).items()})


def optional_join(left: DataFrame, load, keys: list[str], column: str, default: Column) -> DataFrame:
    """Left join to the first row a key of a table that may be missing or lack the columns: then ``column`` is ``default`` everywhere.

    ``load`` is called without arguments; only an analysis error (no such path or column) counts as missing.
    """
    from pyspark.errors import AnalysisException

    try:
        table = load().select(*keys, column)
    except AnalysisException:
        return left.withColumn(column, default)
    return left_lookup(left, table, keys, {column: default}, [F.col(column)])


def column_difference(left: DataFrame, right: DataFrame) -> tuple[list[str], list[str]]:
    """Columns on the left only and on the right only, sorted."""
    a, b = set(left.columns), set(right.columns)
    return sorted(a - b), sorted(b - a)


def in_input_order(df: DataFrame, row: str = "_row") -> DataFrame:
    """Rows sorted by the number they were given before the work, without that column."""
    return df.orderBy(row).drop(row)


def sort_typed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sorted by several columns; text columns that hold whole numbers compare as numbers, others as text after them."""
    keys = []
    for c in columns:
        if df.schema[c].dataType.simpleString() == "string":
            keys += [F.col(c).try_cast("long").asc_nulls_last(), F.col(c).asc_nulls_last()]
        else:
            keys.append(F.col(c).asc_nulls_last())
    return df.orderBy(*keys)


def coalescing_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join in which columns on both sides are merged: the left value, else the right one."""
    both = [c for c in right.columns if c in left.columns and c not in keys]
    renamed = right.select(*keys, *[F.col(c).alias(f"__r_{c}") if c in both else F.col(c) for c in right.columns if c not in keys])
    out = left.join(renamed, keys, how)
    rest = [c for c in renamed.columns if c not in keys and not c.startswith("__r_")]
    return out.select(*[F.coalesce(F.col(c), F.col(f"__r_{c}")).alias(c) if c in both else F.col(c) for c in left.columns], *rest)


def union_aligned(*tables: DataFrame) -> DataFrame:
    """Union by name; missing columns are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def table_diff(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row: keys on the left only, on the right only, on both, and differing values of each column (null-safe)."""
    a = left.select(*[F.col(k).alias(f"a_{k}") for k in keys], *[F.col(c).alias(f"l_{c}") for c in columns], F.lit(True).alias("in_left"))
    b = right.select(*[F.col(k).alias(f"b_{k}") for k in keys], *[F.col(c).alias(f"r_{c}") for c in columns], F.lit(True).alias("in_right"))
    j = a.join(b, all_of([F.col(f"a_{k}") == F.col(f"b_{k}") for k in keys]), "full_outer")
    both = F.col("in_left") & F.col("in_right")
    return j.agg(
        F.count_if(F.col("in_right").isNull()).alias("left_only"),
        F.count_if(F.col("in_left").isNull()).alias("right_only"),
        F.count_if(both).alias("in_both"),
        *[F.count_if(both & ~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))).alias(f"differ_{c}") for c in columns],
    )


def numbered(df: DataFrame, order: list[str], name: str = "row_no") -> DataFrame:
    """Rows numbered from 0 in the given order, without gathering them in one task.

    Rows are range-partitioned, sorted and written once with their place in their partition;
    everything after reads that table, so counts and rows can never come from two different
    partitionings.  Rows equal in ``order`` are told apart by a hash of all columns, which also
    spreads a value that very many share.
    """
    tie = [F.xxhash64(*df.columns)]
    ranged = df.repartitionByRange(*order, *tie).sortWithinPartitions(*order, *tie)
    rows = stage(ranged.withColumn("__i", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("__i", 33), F.col("__i").bitwiseAND((1 << 33) - 1)
    sizes = rows.select(part.alias("__p")).groupBy("__p").agg(F.count("*").alias("__c"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = sizes.select("__p", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o"))
    return rows.withColumn("__p", part).join(F.broadcast(offsets), "__p").withColumn(name, F.col("__o") + place).drop("__p", "__i", "__o")


def positional_join(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Joins the n-th row of one table to the n-th of the other; raises if the lengths differ."""
    a, b = left.count(), right.count()
    if a != b:
        raise ValueError(f"tables of {a} and {b} rows have no common positions")
    return numbered(left, left_order).join(numbered(right, right_order), "row_no")


def flag_members(df: DataFrame, key: str, members: DataFrame, label: str, value: str) -> DataFrame:
    """Sets ``label`` to ``value`` in rows whose key is among ``members``."""
    ids = small(members.select(F.col(members.columns[0]).alias("__k")).dropna().distinct().withColumn("__in", F.lit(True)))
    out = df.join(ids, df[key] == F.col("__k"), "left")
    return out.withColumn(label, F.when(F.col("__in"), F.lit(value)).otherwise(F.col(label))).drop("__k", "__in")


def not_yet_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return todo.join(done.select(key).distinct(), key, "left_anti")


def harmonised_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join on a key that may differ in type: both sides compare as text."""
    r = right.withColumn("__k", F.col(key).cast("string")).drop(key)
    return left.join(r, left[key].cast("string") == r["__k"], how).drop("__k")


def key_overlap(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``n_left, n_right, n_common`` distinct complete keys, and the share of the left keys that are common."""
    a, b = left.select(*keys).dropna().distinct(), right.select(*keys).dropna().distinct()
    both = a.withColumn("s", F.lit(1)).unionByName(b.withColumn("s", F.lit(2))).groupBy(*keys).agg(F.sum("s").alias("s"))
    out = both.agg(F.count_if(F.col("s") != 2).alias("n_left"), F.count_if(F.col("s") != 1).alias("n_right"), F.count_if(F.col("s") == 3).alias("n_common"))
    return out.withColumn("overlap", F.try_divide(F.col("n_common").cast("double"), F.col("n_left")))


def duplicate_summary(df: DataFrame, scopes: dict[str, list[str]]) -> DataFrame:
    """``scope, n_rows, n_duplicate_rows, n_duplicate_keys`` for each named key."""
    out = None
    for scope, keys in scopes.items():
        sizes = df.groupBy(*keys).agg(F.count("*").alias("c"))
        one = sizes.agg(F.lit(scope).alias("scope"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).alias("n_duplicate_rows"), F.count_if(F.col("c") > 1).alias("n_duplicate_keys"))
        out = one if out is None else out.unionByName(one)
    return out
