"""Distribution tails for a handful of aggregated rows (no per-row use)."""

from __future__ import annotations

import math
from statistics import NormalDist

_N = NormalDist()


def z(p: float) -> float:
    return _N.inv_cdf(p)


def two_sided_p(stat: float) -> float:
    return math.erfc(abs(stat) / math.sqrt(2.0))


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of chi-square for integer degrees of freedom, by the finite series."""
    if x <= 0:
        return 1.0
    h = x / 2.0
    if df % 2 == 0:
        term, total = math.exp(-h), 0.0
        for k in range(df // 2):
            total += term
            term *= h / (k + 1)
        return min(1.0, total)
    total = math.erfc(math.sqrt(h))
    term = math.exp(-h) * math.sqrt(h) / math.gamma(1.5)
    for k in range((df - 1) // 2):
        total += term
        term *= h / (k + 1.5)
    return min(1.0, total)


def _binom_sf(k: int, n: int, p: float) -> float:
    """P(X >= k) for X ~ Binomial(n, p), summed in log space."""
    if k <= 0:
        return 1.0
    if p <= 0.0:
        return 0.0
    if p >= 1.0:
        return 1.0
    lp, lq = math.log(p), math.log1p(-p)
    return math.fsum(
        math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
                 + i * lp + (n - i) * lq) for i in range(k, n + 1))


def exact_interval(wins: int, draws: int, level: float = 0.95) -> tuple[float, float]:
    """Exact (Clopper-Pearson) interval for a win rate, by bisection on the tails."""
    if draws < 1 or not 0 <= wins <= draws:
        raise ValueError(f"{wins} of {draws} is no win count")
    if draws <= 0:
        return math.nan, math.nan
    a = (1.0 - level) / 2.0

    def solve(test) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2.0
            lo, hi = (mid, hi) if test(mid) else (lo, mid)
        return (lo + hi) / 2.0

    low = 0.0 if wins == 0 else solve(lambda p: _binom_sf(wins, draws, p) < a)
    high = 1.0 if wins == draws else solve(
        lambda p: 1.0 - _binom_sf(wins + 1, draws, p) > a)
    return low, high
