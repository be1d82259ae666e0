"""Student t distribution from the regularised incomplete beta function."""

from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 + step * d
            c = 1.0 + step / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            change = d * c
            value *= change
        if abs(change - 1.0) < 1e-15:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def two_sided_p(t: float, df: float) -> float:
    """P(|T| > |t|); the normal limit for infinite degrees of freedom."""
    if math.isnan(t) or math.isnan(df) or df <= 0:
        return math.nan
    if math.isinf(df) or df > 1e9:
        return math.erfc(abs(t) / math.sqrt(2.0))
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def quantile(p: float, df: float) -> float:
    """t value with P(T <= t) = p, by bisection on the two-sided tail."""
    if math.isnan(df) or df <= 0:
        return math.nan
    if p == 0.5:
        return 0.0
    tail = 2.0 * min(p, 1.0 - p)
    low, high = 0.0, 1.0
    while two_sided_p(high, df) > tail:
        high *= 2.0
    for _ in range(200):
        middle = (low + high) / 2.0
        if two_sided_p(middle, df) > tail:
            low = middle
        else:
            high = middle
    return math.copysign((low + high) / 2.0, p - 0.5)
