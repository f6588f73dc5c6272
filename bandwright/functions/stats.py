"""Statistics as column expressions, and the special functions their p-values need."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of Wilson's interval of a proportion."""
    p, zz = k / n, z * z
    d = 1 + zz / n
    centre = (p + zz / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / d
    return centre - half, centre + half


def normal_interval(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = k / n
    half = z * F.sqrt(p * (1 - p) / n)
    return p - half, p + half


def chi2_tail(x: float, df: int) -> float:
    """P(X > x) of chi-square, by the series of the regularised lower incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, half = df / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= half / k
        total += term
    return max(0.0, 1.0 - total * math.exp(-half + a * math.log(half) - math.lgamma(a)))


def normal_tail(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def studentised_range_tail(q: float, k: int) -> float:
    """P(Q > q) of the studentised range of k groups with infinite degrees of freedom, by integration over the smallest value."""
    n, lo, hi = 2000, -8.0, 8.0
    step = (hi - lo) / n
    phi = lambda x: math.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    cdf = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
    total = 0.0
    for i in range(n + 1):
        x = lo + i * step
        total += (0.5 if i in (0, n) else 1.0) * k * phi(x) * (cdf(x + q) - cdf(x)) ** (k - 1) * step
    return min(1.0, max(0.0, 1.0 - total))
