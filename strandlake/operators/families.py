"""Column families: many physical columns with a common prefix, carried as one array.

Aggregates over thousands of physical columns cost minutes of planning alone, so a family is
turned into an array once, at ingest, with a small dictionary of its member names; row
functions then work on the array and table aggregates on its exploded form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.common import clean


def family_columns(df: DataFrame, prefix: str) -> list[str]:
    """Columns that start with ``prefix``, in schema order."""
    return [c for c in df.columns if c.startswith(prefix)]


def to_array(df: DataFrame, columns: list[str], name: str, drop: bool = True) -> DataFrame:
    """``columns`` as one array of doubles (NaN becomes null), in the order given."""
    out = df.withColumn(name, F.array(*[clean(F.col(c).cast("double")) for c in columns]))
    return out.drop(*columns) if drop else out


def to_long(df: DataFrame, keep: list[str], array: str, names: list[str] | None = None, value: str = "value") -> DataFrame:
    """One row for each member: ``keep``, ``idx`` (from 0), ``track`` if names are given, ``value``."""
    out = df.select(*keep, F.posexplode(array).alias("idx", value))
    return out.withColumn("track", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("idx") + 1)) if names else out


def vector_scores(array: Column, prefix: str) -> list[Column]:
    """Mean and greatest absolute value (null if all are null) and the sum of log(1 + |x|) (0 then)."""
    size = F.filter(array, lambda x: x.isNotNull())
    magnitudes = F.transform(size, F.abs)
    total = F.aggregate(magnitudes, F.lit(0.0), lambda a, x: a + x)
    return [
        F.when(F.size(size) > 0, total / F.size(size)).alias(f"{prefix}_mean"),
        F.array_max(magnitudes).alias(f"{prefix}_max"),
        F.aggregate(magnitudes, F.lit(0.0), lambda a, x: a + F.log1p(x)).alias(f"{prefix}_sum_log"),
    ]


def top_k_mean(array: Column, k: int) -> Column:
    """Mean of the k greatest absolute values; 0 for k = 0, null if a value is missing."""
    if k == 0:
        return F.lit(0.0)
    top = F.slice(F.sort_array(F.transform(array, F.abs), asc=False), 1, k)
    return F.when(~F.exists(array, lambda x: x.isNull()), F.try_divide(F.aggregate(top, F.lit(0.0), lambda a, x: a + x), F.size(top)))


def signed_extreme(array: Column, names: list[str] | None = None) -> Column:
    """Struct of the value with the greatest magnitude (``value``, sign kept) and its ``idx``; ties go to the lowest index."""
    ranked = F.transform(array, lambda x, i: F.when(x.isNotNull(), F.struct(F.abs(x).alias("m"), (-i).alias("r"), x.alias("v"))))
    best = F.array_max(F.filter(ranked, lambda s: s.isNotNull()))
    idx = -best["r"]
    fields = [best["v"].alias("value"), idx.alias("idx")]
    if names:
        fields.append(F.when(best.isNotNull(), F.element_at(F.array(*[F.lit(n) for n in names]), idx + 1)).alias("track"))
    return F.struct(*fields)


def log2_fold_change(ref: Column, alt: Column, pseudo: float = 1.0) -> Column:
    return F.log2(alt + pseudo) - F.log2(ref + pseudo)


def inverse_sigmoid(p: Column) -> Column:
    """Logit; null where the value is saturated (0 or 1) or outside."""
    return F.when((p > 0) & (p < 1), F.log(p) - F.log1p(-p))
