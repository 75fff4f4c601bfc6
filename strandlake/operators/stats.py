"""Effect sizes, rank statistics, associations, bins and densities over long tables."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.common import clean, small
from strandlake.operators.running import exact_quantiles, running_sums
from strandlake.storage import ship


def class_moments(df: DataFrame, keys: list[str], value: str, positive: Column) -> DataFrame:
    """``keys, n1, m1, v1, n0, m0, v0``: size, mean and sample variance of positives and others (missing values left out)."""
    x = F.col(value)
    rows = df.filter(x.isNotNull() & ~F.isnan(x.cast("double")))
    one, other = F.when(positive, x), F.when(~positive, x)
    aggs = [F.count(one).alias("n1"), F.avg(one).alias("m1"), F.var_samp(one).alias("v1"), F.count(other).alias("n0"), F.avg(other).alias("m0"), F.var_samp(other).alias("v0")]
    return rows.groupBy(*keys).agg(*aggs) if keys else rows.agg(*aggs)


def student(moments: DataFrame) -> DataFrame:
    """Adds ``cohens_d`` (pooled sample deviation), ``t`` and ``df`` of Student's test."""
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / F.nullif(F.col("n1") + F.col("n0") - 2, F.lit(0)))
    gap = F.col("m1") - F.col("m0")
    return moments.select("*", F.try_divide(gap, pooled).alias("cohens_d"), F.try_divide(gap, pooled * F.sqrt(F.try_divide(F.lit(1.0), F.col("n1")) + F.try_divide(F.lit(1.0), F.col("n0")))).alias("t"), (F.col("n1") + F.col("n0") - 2).alias("df"))


def welch(moments: DataFrame) -> DataFrame:
    """Adds standard errors, ``t`` and ``df`` of Welch's test and d over the root mean variance."""
    a, b = F.try_divide(F.col("v1"), F.col("n1")), F.try_divide(F.col("v0"), F.col("n0"))
    gap = F.col("m1") - F.col("m0")
    df = F.try_divide((a + b) ** 2, F.try_divide(a**2, F.col("n1") - 1) + F.try_divide(b**2, F.col("n0") - 1))
    return moments.select("*", F.sqrt(a).alias("sem1"), F.sqrt(b).alias("sem0"), gap.alias("difference"), F.try_divide(gap, F.sqrt(a + b)).alias("t"), df.alias("df"), F.try_divide(gap, F.sqrt((F.col("v1") + F.col("v0")) / 2)).alias("cohens_d"))


def with_p_values(df: DataFrame, t: str = "t", freedom: str = "df", tests: int | None = None) -> DataFrame:
    """Two-sided p of Student's t; with ``tests`` also ``significant`` at 0.05 / tests."""
    from strandlake.functions.special import t_two_sided

    ship(df.sparkSession)

    @F.pandas_udf("double")
    def p(t: pd.Series, f: pd.Series) -> pd.Series:
        pairs = pd.DataFrame({"t": t, "f": f}).drop_duplicates()
        known = {(a, b): t_two_sided(a, b) for a, b in pairs.itertuples(index=False) if not (pd.isna(a) or pd.isna(b)) and b > 0}
        return pd.Series([known.get(x) for x in zip(t, f, strict=True)], dtype="float64")

    out = df.withColumn("p_value", p(F.col(t).cast("double"), F.col(freedom).cast("double")))
    return out.withColumn("significant", F.col("p_value") < 0.05 / tests) if tests else out


def tie_table(df: DataFrame, keys: list[str], value: str, positive: Column) -> DataFrame:
    """``keys, value, n, n1`` for each distinct value: everything rank statistics need, combined before the shuffle."""
    x = F.col(value)
    return df.filter(x.isNotNull() & ~F.isnan(x.cast("double"))).groupBy(*keys, F.col(value).alias("value")).agg(F.count("*").alias("n"), F.count_if(positive).alias("n1"))


def rank_statistics(df: DataFrame, keys: list[str], value: str, positive: Column, least: int = 1) -> DataFrame:
    """``n1, n0, auc, auc_any`` (direction-free), ``rank_biserial`` and ``ks`` for each key; null under ``least`` rows of a class.

    Running sums go over distinct values, not rows, in two levels; ties get average ranks.
    """
    run = running_sums(tie_table(df, keys, value, positive), keys, "value", ["n", "n1"])
    c, c1, t, t1 = (F.col(x) for x in ("upto_n", "upto_n1", "all_n", "all_n1"))
    rank = c - (F.col("n") - 1) / 2.0
    gap = F.abs(F.try_divide(c1.cast("double"), t1) - F.try_divide((c - c1).cast("double"), t - t1))
    agg = [F.max(t1).alias("n1"), (F.max(t) - F.max(t1)).alias("n0"), F.sum(rank * F.col("n1")).alias("r1"), F.max(gap).alias("ks")]
    g = run.groupBy(*keys).agg(*agg) if keys else run.agg(*agg)
    u = F.try_divide(F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0, (F.col("n1") * F.col("n0")).cast("double"))
    enough = (F.col("n1") >= least) & (F.col("n0") >= least)
    auc = F.when(enough, u)
    return g.select(*keys, "n1", "n0", auc.alias("auc"), F.greatest(auc, 1 - auc).alias("auc_any"), (2 * auc - 1).alias("rank_biserial"), F.when(enough, F.col("ks")).alias("ks"))


def spearman(df: DataFrame, x: str, y: str, least: int = 3) -> DataFrame:
    """``n, rho`` by average ranks; null below ``least`` rows or for a constant column."""
    rows = df.select(F.col(x).alias("x"), F.col(y).alias("y")).dropna()

    def ranks(c: str) -> DataFrame:
        run = running_sums(rows.groupBy(c).agg(F.count("*").alias("k")), [], c, ["k"])
        return run.select(c, (F.col("upto_k") - (F.col("k") - 1) / 2.0).alias(f"r{c}"))

    both = rows.join(ranks("x"), "x").join(ranks("y"), "y")
    m = both.agg(F.count("*").alias("n"), F.covar_pop("rx", "ry").alias("c"), F.stddev_pop("rx").alias("sx"), F.stddev_pop("ry").alias("sy"))
    return m.select("n", F.when((F.col("n") >= least) & (F.col("sx") > 0) & (F.col("sy") > 0), F.try_divide(F.col("c"), F.col("sx") * F.col("sy"))).alias("rho"))


def cramers_v(df: DataFrame, x: str, y: str) -> DataFrame:
    """``n, chi2, v`` of the table of two columns (missing left out)."""
    cells = df.select(F.col(x).alias("x"), F.col(y).alias("y")).dropna().groupBy("x", "y").agg(F.count("*").alias("o"))
    # chi2 = n (sum o^2 / (row column) - 1): absent cells add nothing
    rows, cols = cells.groupBy("x").agg(F.sum("o").alias("r")), cells.groupBy("y").agg(F.sum("o").alias("c"))
    j = cells.join(small(rows), "x").join(small(cols), "y")
    g = j.agg(F.sum("o").alias("n"), F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("s"), F.least(F.count_distinct("x"), F.count_distinct("y")).alias("k"))
    chi2 = F.col("n") * (F.col("s") - 1)
    return g.select("n", chi2.alias("chi2"), F.sqrt(F.try_divide(chi2, F.col("n") * (F.col("k") - 1))).alias("v"))


def exact_percentiles(df: DataFrame, value: str, shares: list[float]) -> list[float]:
    """Interpolated percentiles of a whole column, from running counts; only the percentiles come to the driver."""
    got = exact_quantiles(df, [], value, shares).first()
    return list(got.q) if got.n else []


def percent_rank_bins(df: DataFrame, value: str, labels: list[str], name: str = "bin") -> DataFrame:
    """Bins by average percent rank, cut at equal shares: ties share a bin whatever the number of distinct values."""
    x = clean(F.col(value).cast("double"))
    counts = df.select(x.alias("__x")).filter("__x is not null").groupBy("__x").agg(F.count("*").alias("k"))
    run = running_sums(counts, [], "__x", ["k"])
    share = (F.col("upto_k") - (F.col("k") - 1) / 2.0) / F.col("all_k")
    place = F.least(F.ceil(share * len(labels)), F.lit(len(labels))).cast("int")
    named = run.select("__x", F.element_at(F.array(*[F.lit(x) for x in labels]), place).alias(name))
    return df.join(named, x == F.col("__x"), "left").drop("__x")


def quantile_bins(df: DataFrame, value: str, labels: list[str], name: str = "bin", fallback: bool = False) -> DataFrame:
    """Equal-share bins, closed above, the least value in the first; repeated edges merge and the first labels are used.

    With ``fallback`` a column whose edges repeat is cut by percent rank instead.
    """
    k = len(labels)
    edges = exact_percentiles(df, value, [i / k for i in range(k + 1)])
    kept = sorted(set(edges))
    if fallback and len(kept) < k + 1:
        return percent_rank_bins(df, value, labels, name)
    tests = [(F.col(value) <= e, labels[i]) for i, e in enumerate(kept[1:] or kept)]
    out = F.lit(None).cast("string")
    for condition, label in reversed(tests):
        out = F.when(condition, F.lit(label)).otherwise(out)
    return df.withColumn(name, F.when(F.col(value).isNotNull(), out))


def ordinal(value: Column, levels: list[str]) -> Column:
    """Place of a value among ordered levels, from 0; null for others."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in levels]), value), F.lit(0).cast("long")) - 1


def clip_percentiles(df: DataFrame, value: str, low: float = 0.005, high: float = 0.995) -> DataFrame:
    got = exact_percentiles(df, value, [low, high])
    if not got:
        return df.limit(0)
    a, z = got
    return df.filter(F.col(value).between(a, z))


def histogram(df: DataFrame, value: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """``bin`` (1 to bins), ``n``; the greatest value falls in the last bin."""
    if low is None or high is None:
        low, high = df.agg(F.min(value), F.max(value)).first()
        if low is None:
            return df.select(F.lit(1).cast("long").alias("bin"), F.lit(0).cast("long").alias("n")).limit(0)
    if low == high:
        bin_ = F.lit(1)
    else:
        bin_ = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)) + 1, F.lit(bins))
    return df.filter(F.col(value).between(low, high)).groupBy(bin_.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def gaussian_density(df: DataFrame, value: str, points: int = 500, cells: int | None = None) -> DataFrame:
    """``x, density`` on an even grid from the least to the greatest value, Scott's bandwidth.

    Samples are counted by distinct value, and each value reaches only those grid points where
    its kernel is not zero in double precision (38.6 bandwidths), so the result is exact.  With
    ``cells`` values are first rounded to so many even cells, which bounds the work for columns
    with very many distinct values at an error of half a cell in the place of a sample.
    """
    rows = df.select(clean(F.col(value).cast("double")).alias("v")).filter("v is not null")
    if cells:
        low, high = rows.agg(F.min("v"), F.max("v")).first()
        if low is not None and low < high:
            step = (high - low) / cells
            rows = rows.select((F.lit(low) + F.round((F.col("v") - low) / step) * step).alias("v"))
    counted = rows.groupBy("v").agg(F.count("*").alias("k"))
    n, low, high, m1, m2 = counted.agg(F.sum("k"), F.min("v"), F.max("v"), F.sum(F.col("v") * F.col("k")), F.sum(F.col("v") * F.col("v") * F.col("k"))).first()
    if not n or n < 2 or low == high:
        return counted.select(F.col("v").alias("x"), F.lit(0.0).alias("density")).limit(0)
    sd = math.sqrt(max(0.0, (m2 - m1 * m1 / n) / (n - 1)))
    h = sd * n ** (-1 / 5)
    step = (high - low) / (points - 1)
    reach = 38.6 * h
    first = F.greatest(F.lit(0), F.ceil((F.col("v") - reach - low) / step)).cast("int")
    last = F.least(F.lit(points - 1), F.floor((F.col("v") + reach - low) / step)).cast("int")
    parts = counted.select("k", "v", F.explode(F.sequence(first, last)).alias("i")).withColumn("x", F.lit(low) + F.col("i") * step)
    weight = F.col("k") * F.exp(-0.5 * ((F.col("x") - F.col("v")) / h) ** 2)
    sums = parts.groupBy("i").agg(F.sum(weight).alias("w"))
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("i"), (F.lit(low) + F.col("id") * step).alias("x"))
    return grid.join(F.broadcast(sums), "i", "left").select("x", (F.coalesce("w", F.lit(0.0)) / (n * h * math.sqrt(2 * math.pi))).alias("density"))


def frame_class(size: Column) -> Column:
    """``In-frame`` for multiples of three, else ``Frameshift``; null for no change."""
    return F.when(size == 0, None).when(F.abs(size) % 3 == 0, "In-frame").otherwise("Frameshift")


def coverage_rule(df: DataFrame, column: str, is_indel: Column, least: float = 0.95) -> DataFrame:
    """``coverage`` of a column among rows that are no indels, and the subset it may be judged on."""
    g = df.agg(F.try_divide(F.count_if(~is_indel & F.col(column).isNotNull()).cast("double"), F.count_if(~is_indel)).alias("coverage"))
    return g.withColumn("subset", F.when(F.col("coverage") >= least, "All").otherwise("Indels"))


def shared_label(df: DataFrame, keys: list[str], label: str, both: str = "Both") -> DataFrame:
    """Rows whose key occurs more than once get the label ``both``."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__c"))
    return df.join(sizes, keys).withColumn(label, F.when(F.col("__c") > 1, both).otherwise(F.col(label))).drop("__c")


def bootstrap_mean(df: DataFrame, unit: str, value: str, rounds: int = 200, seed: int = 42) -> DataFrame:
    """``low, high``: 95 % limits of the mean by a Poisson bootstrap over units.

    Each unit draws its weight for every round from the MD5 of ``seed:unit:round // 4`` (a
    quarter of the digest a round), so nothing is resampled or gathered and any engine draws
    the same; units are summed first.
    """
    units = df.filter(F.col(value).isNotNull()).groupBy(unit).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    fours = units.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit((rounds - 1) // 4))))
    fours = fours.withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(unit).cast("string"), F.col("g").cast("string"))))
    draw = fours.withColumn("j", F.explode(F.array(*[F.lit(j) for j in range(4)]))).withColumn("b", 4 * F.col("g") + F.col("j")).filter(F.col("b") < rounds)
    u = F.conv(F.substring("h", 8 * F.col("j") + 1, F.lit(8)), 16, 10).cast("double") / float(1 << 32)
    steps, total, term = [], 0.0, math.exp(-1)
    for k in range(12):
        total += term
        steps.append((total, k))
        term /= k + 1
    weight = F.lit(12)
    for t, k in reversed(steps):
        weight = F.when(u < t, k).otherwise(weight)
    means = draw.withColumn("w", weight).groupBy("b").agg(F.try_divide(F.sum(F.col("w") * F.col("s")), F.sum(F.col("w") * F.col("c")).cast("double")).alias("m"))
    return means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def average_precision(df: DataFrame, value: str, positive: Column) -> DataFrame:
    """Area under precision and recall, ties taken together: ``n1, average_precision``."""
    run = running_sums(tie_table(df, [], value, positive), [], "value", ["n", "n1"])
    from_top = lambda c: F.col(f"all_{c}") - F.col(f"upto_{c}") + F.col(c)
    return run.agg(F.coalesce(F.max("all_n1"), F.lit(None).cast("long")).alias("n1"), F.try_divide(F.sum(F.col("n1") * from_top("n1") / from_top("n")), F.max("all_n1").cast("double")).alias("average_precision"))


def cohens_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """``n, agreement, kappa`` of two columns of labels (missing left out)."""
    cells = df.select(F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")).dropna().groupBy("x", "y").agg(F.count("*").alias("o"))
    sides = cells.select("x", F.col("o").alias("p"), F.lit(0).cast("long").alias("q")).unionByName(cells.select(F.col("y").alias("x"), F.lit(0).cast("long").alias("p"), F.col("o").alias("q")))
    chance = sides.groupBy("x").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).agg(F.sum(F.col("p").cast("double") * F.col("q")).alias("e"))
    g = cells.agg(F.sum("o").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("o")).otherwise(0)).alias("same")).join(F.broadcast(chance))  # one row each
    po, pe = F.try_divide(F.col("same").cast("double"), F.col("n")), F.try_divide(F.col("e"), F.col("n").cast("double") * F.col("n"))
    return g.select("n", po.alias("agreement"), F.try_divide(po - pe, 1 - pe).alias("kappa"))


def mean_interval(moments: DataFrame, share: float = 0.95) -> DataFrame:
    """Adds ``low1, high1, low0, high0``: Student intervals of both means of ``class_moments`` (a few rows; null below two values)."""
    from strandlake.functions.special import t_quantile

    ship(moments.sparkSession)

    @F.pandas_udf("double")
    def reach(n: pd.Series) -> pd.Series:
        known = {f: t_quantile(0.5 + share / 2, f) for f in set((n[n > 1] - 1).tolist())}
        return n.map(lambda k: known.get(k - 1))

    out = moments
    for side in "10":
        width = reach(F.col(f"n{side}").cast("double")) * F.sqrt(F.try_divide(F.col(f"v{side}"), F.col(f"n{side}").cast("double")))
        out = out.withColumns({f"low{side}": F.col(f"m{side}") - width, f"high{side}": F.col(f"m{side}") + width})
    return out
