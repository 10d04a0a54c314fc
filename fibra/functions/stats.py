"""Distribution functions, from their definitions (continued fraction, bisection)."""

from __future__ import annotations

import math
from statistics import NormalDist


def betainc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 400):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's t."""
    return betainc(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, df1: float, df2: float) -> float:
    """P(F >= f)."""
    return 1.0 - betainc(df1 / 2, df2 / 2, df1 * f / (df1 * f + df2)) if f > 0 else 1.0


def chi2_quantile_1(p: float) -> float:
    """The p-quantile of chi-square with one degree of freedom."""
    return NormalDist().inv_cdf((1 + p) / 2) ** 2


def binomial_upper(r: int, m: int, p: float) -> float:
    """P(Binomial(m, p) >= r)."""
    return sum(math.comb(m, i) * p**i * (1 - p) ** (m - i) for i in range(r, m + 1))


def exceedance_probability(false_alarm: float, r: int, m: int) -> float:
    """The single-sample probability at which r of m samples exceed with probability ``false_alarm``."""
    lo, hi = 1e-6, 1 - 1e-6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if binomial_upper(r, m, mid) < false_alarm else (lo, mid)
    return (lo + hi) / 2
