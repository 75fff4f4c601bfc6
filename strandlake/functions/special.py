"""Distribution functions, in plain Python (no scientific library is needed)."""

from __future__ import annotations

import math


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function: its continued fraction, evaluated from the tail."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    g = 1.0
    for i in range(400, 0, -1):
        m = i // 2
        step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        g = 1 + step / g
    return front / g


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p value of Student's t."""
    if math.isinf(t):
        return 0.0
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def t_quantile(share: float, df: float) -> float:
    """The value that Student's t stays below with probability ``share`` (0.5 or more), by bisection."""
    tail, low, high = 2 * (1 - share), 0.0, 1.0
    while t_two_sided(high, df) > tail:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) > tail else (low, mid)
    return (low + high) / 2


def ks_two_sided(d: float, n1: int, n0: int) -> float:
    """Asymptotic p value of the two-sample Kolmogorov-Smirnov statistic."""
    if d <= 0:
        return 1.0
    z = d * math.sqrt(n1 * n0 / (n1 + n0))
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 101))))
