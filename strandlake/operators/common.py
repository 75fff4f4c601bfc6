"""Small helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.storage import is_small

#: Largest number of rows of a dimension that may be broadcast.
BROADCAST_ROWS = 250_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS, of: DataFrame | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it is small in rows and bytes (``storage.is_small``); beyond that the join shuffles."""
    return F.broadcast(df) if is_small(df, rows, of=of) else df


def clean(x: Column) -> Column:
    """NaN as null: missing values are null everywhere in this library."""
    return F.when(~F.isnan(x), x)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return all_of([left[k].eqNullSafe(right[k]) for k in keys])
