"""Vector functions on array columns, and sequence slices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def doubles(array: Column) -> Column:
    """32-bit values as doubles, so that sums do not depend on the order."""
    return F.transform(array, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_softmax(logits: Column) -> Column:
    """Stable: the greatest logit is taken off first."""
    return F.transform(logits, lambda x: x.cast("double") - F.array_max(logits).cast("double") - F.log(_sum(F.transform(logits, lambda y: F.exp(y.cast("double") - F.array_max(logits).cast("double"))))))


def softmax(logits: Column) -> Column:
    return F.transform(log_softmax(logits), F.exp)


def kl_divergence(p: Column, q: Column) -> Column:
    """KL(p || q) of two probability arrays; terms with p = 0 are 0."""
    return _sum(F.zip_with(p, q, lambda x, y: F.when(x > 0, x * (F.log(x) - F.log(y))).otherwise(0.0)))


def log_likelihood_ratio(ref_p: Column, alt_p: Column, eps: float = 1e-10) -> Column:
    return F.log(F.try_divide(alt_p, ref_p + eps) + eps)


def five_mer(window: Column, center: Column) -> Column:
    """Five letters around the 0-based ``center``; NNNNN where the window is too short."""
    return F.when((center >= 2) & (center + 3 <= F.length(window)), F.substring(window, center - 1, F.lit(5))).otherwise("NNNNN")


def splice_allele(sequence: Column, offset: Column, ref: Column, alt: Column) -> Column:
    """The sequence with ``ref`` at the 0-based ``offset`` replaced, cut back to the old length; null if the letters there differ."""
    there = F.substring(sequence, offset + 1, F.length(ref))
    made = F.concat(F.left(sequence, offset), alt, F.substring(sequence, offset + F.length(ref) + 1, F.length(sequence)))
    return F.when(F.upper(there) == F.upper(ref), F.left(made, F.length(sequence)))


def reverse_complement(sequence: Column) -> Column:
    return F.translate(F.reverse(sequence), "ACGTacgt", "TGCAtgca")


def piecewise_linear(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Linear between knots, constant beyond them."""
    out = F.lit(float(knots[-1][1]))
    for (a, fa), (b, fb) in reversed(list(zip(knots, knots[1:], strict=False))):
        out = F.when(x <= b, fa + (x - a) * ((fb - fa) / (b - a))).otherwise(out)
    return F.when(x <= knots[0][0], F.lit(float(knots[0][1]))).otherwise(out)
