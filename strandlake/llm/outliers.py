"""Operator 4: quality rules by robust multivariate outliers.

For every language and source the location and scatter of a vector of transformed text
statistics are estimated by the minimum covariance determinant: from deterministic starts,
concentration steps keep the share ``core`` of the group with the least distances and
estimate anew, until the determinant no longer falls; the start with the least determinant
wins, and a reweighting step follows.  Documents whose squared Mahalanobis distance exceeds
the chi-squared quantile ``cut`` are rejected.

The vector: log of the mean word length (ten words of five characters added, so that short texts
scatter no more than long ones), square root of the share of symbols, share of
repeated lines, share of words in repeated windows.  Most documents have no symbols and no
repeats at all, so the scatter of a core can vanish.  Its diagonal is therefore raised to the
square of a floor at least: the spread of the rows of the group that differ from its median
(1.4826 times the median of their distances from it), at most ``LIMITS / sqrt(cut)`` and at
least ``LEAST`` of that, which is also the least that is added, so that the scatter stays
regular.  Where the core of a group has no repeats or symbols, a document goes by one statistic
alone beyond ``LIMITS`` (30 % repeated lines, 2 % symbols), or, where that is less, beyond 7.2
times the median of the rows of the group that have any (but not below a tenth of the limit):
with a median of 2 %, over 14.4 % of the words in repeated windows.

Everything is DataFrame functions.  Distances are ranked by histograms of fixed resolution
(``BINS`` a unit of log distance), which combine before the shuffle: no group, however large,
is sorted or gathered, and results do not depend on the partitioning.  The concentrated
part is the least set of whole bins that holds the share.

Special cases: null texts have no words and fail the base rule; null languages and sources
form groups of their own; groups with fewer than ``min_group`` documents share one group of
their language, and if that is small too one of all; if that is small as well nothing is
rejected; ties and repeated rows count each; empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import Scratch, drop_folder, small, stage, text_hash
from strandlake.llm.textstats import with_text_stats

#: Distances from the centre that reject alone in a group whose core has no spread: a mean word half as long again,
#: 2 % symbols, 30 % repeated lines, 40 % words in repeated windows (the base rule ends at 20 %: below, the group's own spread decides).
LIMITS = (math.log(1.5), math.sqrt(0.02), 0.30, 0.40)
#: Least floor as a share of the greatest; keeps the scatter regular where a statistic is constant.
LEAST = 0.1
#: Quantile of chi-squared beyond which documents are rejected.
CUT = 0.9999
P = len(LIMITS)
BINS = 200
X = [f"x{i}" for i in range(P)]


def chi2_cdf(x: float, k: int) -> float:
    """Distribution function of chi-squared with k degrees, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return high


def _vector() -> list[Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return [
        F.log((chars + 50) / (words + 10)),
        F.sqrt(F.col("n_symbols") / chars),
        F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        F.col("n_repeat_words") / words,
    ]


def _scatter(cells: dict[tuple[int, int], Column]) -> list[Column]:
    """Cholesky factor (named l00, l10, ...) of a scatter matrix given as columns."""
    low: dict[tuple[int, int], Column] = {}
    for i in range(P):
        for j in range(i + 1):
            rest = cells[i, j]
            for k in range(j):
                rest = rest - low[i, k] * low[j, k]
            low[i, j] = F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / low[j, j]
    return [low[i, j].alias(f"l{i}{j}") for i in range(P) for j in range(i + 1)]


def _distance() -> Column:
    """Squared Mahalanobis distance of a row joined with centre (m*) and factor (l*)."""
    y: list[Column] = []
    for i in range(P):
        rest = F.col(X[i]) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * y[k]
        y.append(rest / F.col(f"l{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _raised(cells: dict[tuple[int, int], Column]) -> dict[tuple[int, int], Column]:
    """A scatter matrix with its diagonal raised to the squared floors (f*), and by the square of the least floor at least."""
    least = [(LEAST * x) ** 2 / chi2_quantile(CUT, P) for x in LIMITS]
    return {(i, j): F.greatest(c + least[i], F.col(f"f{i}") * F.col(f"f{i}")) if i == j else c for (i, j), c in cells.items()}


#: Count, sums and products from which moments follow.
SUMS = ["k", *[f"s_{x}" for x in X], *[f"s_{i}_{j}" for i in range(P) for j in range(i + 1)]]


def _sums() -> list[Column]:
    products = [F.sum(F.col(X[i]) * F.col(X[j])).alias(f"s_{i}_{j}") for i in range(P) for j in range(i + 1)]
    return [F.count("*").alias("k"), *[F.sum(x).alias(f"s_{x}") for x in X], *products]


def _moments(sums: DataFrame, floors: DataFrame, factor: float) -> DataFrame:
    """Centre and factor of each (g, start) from its ``SUMS``; ``factor`` makes the scatter consistent."""
    mean = {i: F.col(f"s_{X[i]}") / F.col("k") for i in range(P)}
    sums = sums.join(small(floors), "g")
    cells = {(i, j): factor * (F.col(f"s_{i}_{j}") / F.col("k") - mean[i] * mean[j]) for i in range(P) for j in range(i + 1)}
    return _with_det(sums.select("g", "start", *[mean[i].alias(f"m{i}") for i in range(P)], *_scatter(_raised(cells))))


def _with_det(fit: DataFrame) -> DataFrame:
    return fit.withColumn("log_det", sum(F.log(F.col(f"l{i}{i}")) for i in range(P)) * 2)


def _medians(long: DataFrame, step: float = 1e-3) -> DataFrame:
    """Median of ``v`` for each (g, dim), to a resolution of ``step``."""
    bins = long.groupBy("g", "dim", F.round(F.col("v") / step).cast("long").alias("bin")).agg(F.count("*").alias("c"))
    order = Window.partitionBy("g", "dim")
    bins = bins.withColumn("below", F.sum("c").over(order.orderBy("bin"))).withColumn("n", F.sum("c").over(order))
    return bins.filter(2 * F.col("below") >= F.col("n")).groupBy("g", "dim").agg((F.min("bin") * step).alias("med"))


def _floors() -> list[Column]:
    """Floors f* of a group from the spread d* of its rows off the median (null if there are none)."""
    most = [x / math.sqrt(chi2_quantile(CUT, P)) for x in LIMITS]
    return [F.least(F.greatest(F.coalesce(1.4826 * F.col(f"d{i}"), F.lit(0.0)), F.lit(LEAST * most[i])), F.lit(most[i])).alias(f"f{i}") for i in range(P)]


def _starts(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Three starts for each group - medians with median absolute deviations, medians with the floors alone, means with the whole scatter - and the floors."""
    long = rows.select("g", F.posexplode(F.array(*X)).alias("dim", "v"))
    med = scratch.stage(_medians(long), "mcd-medians")
    away = long.join(small(med), ["g", "dim"]).select("g", "dim", F.abs(F.col("v") - F.col("med")).alias("v"))
    # both medians of the distances, of all rows and of those off the median, from one histogram
    bins = away.groupBy("g", "dim", F.round(F.col("v") / 1e-3).cast("long").alias("bin")).agg(F.count("*").alias("c"), F.count_if(F.col("v") > 1e-3).alias("e"))
    order = Window.partitionBy("g", "dim")
    for c in ("c", "e"):
        bins = bins.withColumn(f"{c}_below", F.sum(c).over(order.orderBy("bin"))).withColumn(f"{c}_all", F.sum(c).over(order))
    middle = lambda c: F.min(F.when((F.col(c) > 0) & (2 * F.col(f"{c}_below") >= F.col(f"{c}_all")), F.col("bin"))) * 1e-3
    spread = bins.groupBy("g", "dim").agg(middle("c").alias("mad"), middle("e").alias("off"))
    both = med.join(spread, ["g", "dim"]).groupBy("g").agg(*[F.max(F.when(F.col("dim") == i, F.col(c))).alias(f"{n}{i}") for n, c in (("m", "med"), ("a", "mad"), ("d", "off")) for i in range(P)])
    both = scratch.stage(both.select("*", *_floors()), "mcd-floors")
    cells = {(i, j): (F.col("start") * (1.4826 * F.col(f"a{i}")) ** 2 if i == j else F.lit(0.0)) for i in range(P) for j in range(i + 1)}
    starts = both.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    starts = _with_det(starts.select("g", "start", *[f"m{i}" for i in range(P)], *_scatter(_raised(cells))))
    floors = scratch.stage(both.select("g", *[f"f{i}" for i in range(P)]), "mcd-floors")
    return starts.unionByName(_moments(rows.withColumn("start", F.lit(2)).groupBy("g", "start").agg(*_sums()), floors, 1.0)), floors


def _concentrate(rows: DataFrame, fit: DataFrame, floors: DataFrame, core: float) -> DataFrame:
    """One concentration step: moments of the share ``core`` with the least distances.

    One pass: sums by bin of distance, of which the least whole bins that hold the share are added up.
    """
    far = rows.join(small(fit), "g").withColumn("bin", F.floor(F.log1p(_distance() * 100) * BINS))
    bins = far.groupBy("g", "start", "bin").agg(*_sums())
    group = Window.partitionBy("g", "start")
    bins = bins.withColumn("before", F.sum("k").over(group.orderBy("bin")) - F.col("k")).withColumn("n", F.sum("k").over(group))
    sums = bins.filter(F.col("before") < F.ceil(F.col("n") * core)).groupBy("g", "start").agg(*[F.sum(c).alias(c) for c in SUMS])
    return _moments(sums, floors, core / chi2_cdf(chi2_quantile(core, P), P + 2))


def robust_distances(rows: DataFrame, core: float = 0.5, tolerance: float = 1e-4, bound: int = 100) -> DataFrame:
    """``rows`` (with ``g`` and the vector, staged) plus ``distance2`` by the estimates of its group ``g``; null where ``g`` is.

    Steps go on for each start of each group until its determinant falls by ``tolerance`` (of its log) no more;
    if one still falls after ``bound`` steps, that is an error.
    """
    scratch = Scratch(rows.sparkSession)
    fitted = rows.filter(F.col("g").isNotNull() & F.col("fit")).select("g", *X)
    starts, floors = _starts(fitted, scratch)
    fit = scratch.stage(starts, "mcd-fit")
    fit = scratch.stage(_concentrate(fitted, fit, floors, core), "mcd-fit")
    settled = []
    for _ in range(bound):
        was = fit.select("g", "start", F.col("log_det").alias("was"))
        new = _concentrate(fitted, fit, floors, core).join(small(was, of=fit), ["g", "start"])
        new = scratch.stage(new.withColumn("falls", F.col("log_det") < F.col("was") - tolerance).drop("was"), "mcd-fit")
        settled.append(new.filter(~F.col("falls")).drop("falls"))
        fit = new.filter("falls").drop("falls")
        if fit.isEmpty():
            break
        fit.staged_at, fit.staged_rows = new.staged_at, new.staged_rows  # a part of that table
    else:
        raise RuntimeError("concentration steps did not settle")
    fit = reduce(DataFrame.unionByName, settled)
    best = fit.groupBy("g").agg(F.min_by(F.struct(*[c for c in fit.columns if c != "g"]), F.struct("log_det", "start")).alias("b")).select("g", "b.*")
    best = scratch.stage(best, "mcd-best")
    near = 0.975
    inside = fitted.join(small(best), "g").filter(_distance() <= chi2_quantile(near, P))
    last = scratch.stage(_moments(inside.groupBy("g", "start").agg(*_sums()), floors, near / chi2_cdf(chi2_quantile(near, P), P + 2)).drop("log_det", "start"), "mcd-last")
    scratch.drop(last)
    cols = [F.col(c) for c in rows.columns]
    return rows.join(small(last), "g", "left").select(*cols, _distance().alias("distance2"))


def quality_verdicts(docs: DataFrame, cut: float = CUT, core: float = 0.5, min_group: int = 40, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Statistics and verdict of every row.

    ``doc_id, text_hash, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, base_failed, distance2, kept``.  ``base_failed``: fewer than 10 words, or
    more than a fifth of them in repeated windows; such rows are no part of the estimates.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), text_hash(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    rows = with_text_stats(rows, "text", ["doc_id", "text_hash", "lang", "source"])
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = stage(rows.select("*", failed.alias("base_failed"), *[v.cast("double").alias(x) for v, x in zip(_vector(), X, strict=True)]), "text-stats")

    # the group of each language and source: itself, all small ones of the language, or all that remain
    sizes = rows.filter(~F.col("base_failed")).groupBy("lang", "source").agg(F.count("*").alias("n"))
    lang = Window.partitionBy("lang", F.col("n") >= min_group)
    sizes = sizes.withColumn("pool", F.sum("n").over(lang))
    small_pool = F.col("pool") < min_group
    sizes = sizes.withColumn("rest", F.sum(F.when(small_pool, F.col("n"))).over(Window.partitionBy(small_pool)))
    own = F.to_json(F.struct(F.lit(0).alias("k"), "lang", "source"))
    groups = sizes.select(
        F.col("lang").alias("gl"),
        F.col("source").alias("gs"),
        F.when(F.col("n") >= min_group, own).when(~small_pool, F.to_json(F.struct(F.lit(1).alias("k"), "lang"))).when(F.col("rest") >= min_group, F.lit("all")).alias("g"),
    )
    groups = stage(groups, "mcd-groups")
    joined = rows.join(small(groups), F.col("lang").eqNullSafe(F.col("gl")) & F.col("source").eqNullSafe(F.col("gs")), "left")
    joined = stage(joined.drop("gl", "gs").withColumn("fit", ~F.col("base_failed")), "mcd-rows")
    for done in (rows, groups):
        drop_folder(docs.sparkSession, done.staged_at)
    out = robust_distances(joined, core)
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance2") <= chi2_quantile(cut, P), F.lit(True))
    return out.select("doc_id", "text_hash", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "distance2", kept.alias("kept"))
