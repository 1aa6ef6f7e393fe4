"""Plain numbers: quantiles and tail probabilities without a statistics library."""

from __future__ import annotations

import math


def _beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    total = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + step * d) or 1e-300)
            c = (1 + step / c) or 1e-300
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * total


def t_tail(t: float, df: int) -> float:
    """Probability that Student's t is farther from 0 than t, on both sides."""
    return _beta(df / (df + t * t), df / 2, 0.5)


def t_quantile(confidence: float, df: int) -> float:
    """Half-width, in standard errors, of the two-sided interval."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_tail(mid, df) > 1 - confidence else (low, mid)
    return (low + high) / 2


def ks_tail(lam: float) -> float:
    """Probability that the Kolmogorov-Smirnov statistic, scaled, exceeds lam."""
    if lam <= 0:
        return 1.0
    return max(0.0, min(1.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * (j * lam) ** 2) for j in range(1, 101))))


def poisson(rate: float, n: int) -> float:
    return math.exp(-rate + n * math.log(rate) - math.lgamma(n + 1)) if rate > 0 else float(n == 0)


def binomial(n: int, k: int) -> int:
    return math.comb(n, k) if 0 <= k <= n else 0


def hypergeometric_tail(total: int, good: int, drawn: int, hits: int) -> float:
    """Probability of that many hits or more."""
    top = min(good, drawn)
    return min(1.0, sum(math.comb(good, i) * math.comb(total - good, drawn - i) for i in range(hits, top + 1)) / math.comb(total, drawn))


def f1(precision: float, recall: float) -> float:
    return 2 * precision * recall / (precision + recall) if precision + recall else 0.0


def bin_width(q1: float, q3: float, n: int) -> float:
    """Twice the range between quartiles over the cube root of n."""
    return 2 * (q3 - q1) / n ** (1 / 3) if n else 0.0
