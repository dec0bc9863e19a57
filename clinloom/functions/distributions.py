"""Tail probabilities and quantiles of the common distributions, on the driver."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np

_N = NormalDist()


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def norm_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def norm_ppf(p: float) -> float:
    return _N.inv_cdf(p)


def gamma_sf(a: float, x: float) -> float:
    """The upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h / a


def chi2_sf(x: float, df: float) -> float:
    return gamma_sf(df / 2, x / 2)


def t_sf2(t: float, df: float) -> float:
    """Both tails."""
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def f_sf(x: float, d1: float, d2: float) -> float:
    return beta_cdf(d2 / (d2 + d1 * x), d2 / 2, d1 / 2) if x > 0 else 1.0


def t_ppf(p: float, df: float) -> float:
    lo, hi = -1e6, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        below = 1 - t_sf2(mid, df) / 2 if mid >= 0 else t_sf2(mid, df) / 2
        lo, hi = (mid, hi) if below < p else (lo, mid)
    return (lo + hi) / 2


@lru_cache(maxsize=4)
def _nodes(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.legendre.leggauss(n)


def _range_cdf(w: np.ndarray, k: int) -> np.ndarray:
    """The range of k standard normal values."""
    x, g = _nodes(120)
    z = 8 * x
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    cdf = np.vectorize(norm_cdf)
    inner = np.clip(cdf(z[None, :]) - cdf(z[None, :] - w[:, None]), 0, None)
    return k * (8 * g * phi * inner ** (k - 1)).sum(axis=1)


def tukey_sf(q: float, k: int, df: float) -> float:
    """The studentised range."""
    if q <= 0:
        return 1.0
    x, g = _nodes(120)
    # the scale s has the density of a chi over the root of its degrees of freedom
    spread = 8 / math.sqrt(2 * df)
    lo, hi = max(1e-8, 1 - spread), 1 + spread
    s = (hi - lo) / 2 * x + (hi + lo) / 2
    log = df / 2 * math.log(df) - math.lgamma(df / 2) - (df / 2 - 1) * math.log(2) + (df - 1) * np.log(s) - df * s * s / 2
    return float(min(1, max(0, 1 - ((hi - lo) / 2 * g * np.exp(log) * _range_cdf(q * s, k)).sum())))


def adjust(p: list[float | None], method: str = "BH") -> list[float | None]:
    """p-values adjusted for their number, missing ones apart."""
    at = [i for i, v in enumerate(p) if v is not None and not math.isnan(v)]
    n = len(at)
    out: list[float | None] = [None] * len(p)
    v = np.array([p[i] for i in at], dtype=float)
    if not n:
        return out
    if method == "none":
        got = v
    elif method == "bonferroni":
        got = np.minimum(1, v * n)
    elif method in ("holm", "hochberg", "BH", "fdr", "BY"):
        order = np.argsort(v, kind="stable")
        rank = np.arange(1, n + 1)
        s = v[order]
        if method == "holm":
            a = np.maximum.accumulate((n - rank + 1) * s)
        elif method == "hochberg":
            a = np.minimum.accumulate(((n - rank + 1) * s)[::-1])[::-1]
        else:
            q = (1 / rank).sum() if method == "BY" else 1.0
            a = np.minimum.accumulate((q * n / rank * s)[::-1])[::-1]
        got = np.empty(n)
        got[order] = np.minimum(1, a)
    else:
        raise ValueError(f"unknown method {method}")
    for i, g in zip(at, got):
        out[i] = float(g)
    return out
