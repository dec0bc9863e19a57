"""Tests of normality and the choice of how to describe variables."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinloom.functions.distributions import chi2_sf, norm_cdf, norm_ppf, norm_sf


def _scores(n: int) -> np.ndarray:
    """Blom's approximate expected order statistics."""
    return np.array([norm_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])


def shapiro_wilk(x: np.ndarray) -> float:
    """p-value after Royston (1995), for 3 to 5000 values."""
    x, n = np.sort(x), len(x)
    if not 3 <= n <= 5000 or x[0] == x[-1]:
        raise ValueError("3 to 5000 values that are not all equal")
    m = _scores(n)
    mm = float(m @ m)
    u = 1 / math.sqrt(n)
    a = np.zeros(n)
    if n == 3:
        a[2], a[0] = math.sqrt(0.5), -math.sqrt(0.5)
    else:
        last = m[-1] / math.sqrt(mm) + np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0], u)
        if n > 5:
            prev = m[-2] / math.sqrt(mm) + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0], u)
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * prev**2)
            a[2:-2] = m[2:-2] / math.sqrt(phi)
            a[-2], a[1] = prev, -prev
        else:
            phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a[1:-1] = m[1:-1] / math.sqrt(phi)
        a[-1], a[0] = last, -last
    w = min(1.0, float(a @ x) ** 2 / float(((x - x.mean()) ** 2).sum()))
    if n == 3:
        return max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w >= 1:
        return 1.0
    y, ln = math.log(1 - w), math.log(n)
    if n <= 11:
        g = 0.459 * n - 2.273
        if y >= g:
            return 1e-99
        y = -math.log(g - y)
        mu, sd = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        mu, sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return norm_sf((y - mu) / sd)


def shapiro_francia(x: np.ndarray) -> float:
    """p-value after Royston (1993), for 5 to 5000 values."""
    x, n = np.sort(x), len(x)
    if not 5 <= n <= 5000:
        raise ValueError("5 to 5000 values")
    w = float(np.corrcoef(x, _scores(n))[0, 1]) ** 2
    u = math.log(n)
    v = math.log(u)
    mu, sd = -1.2725 + 1.0521 * (v - u), 1.0308 - 0.26758 * (v + 2 / u)
    return norm_sf((math.log(1 - w) - mu) / sd)


def _uniform(x: np.ndarray) -> np.ndarray:
    z = (np.sort(x) - x.mean()) / x.std(ddof=1)
    return np.array([norm_cdf(v) for v in z])


def lilliefors(x: np.ndarray) -> float:
    """p-value after Dallal and Wilkinson (1986), and Stephens (1974) above a tenth."""
    n = len(x)
    if n < 5:
        raise ValueError("5 values at least")
    p, i = _uniform(x), np.arange(1, n + 1)
    k = max((i / n - p).max(), (p - (i - 1) / n).max())
    kd, nd = (k, n) if n <= 100 else (k * (n / 100) ** 0.49, 100)
    out = math.exp(-7.01256 * kd**2 * (nd + 2.78019) + 2.99587 * kd * math.sqrt(nd + 2.78019) - 0.122119 + 0.974598 / math.sqrt(nd) + 1.67997 / nd)
    if out > 0.1:
        kk = (math.sqrt(n) - 0.01 + 0.85 / math.sqrt(n)) * k
        if kk <= 0.302:
            return 1.0
        if kk <= 0.5:
            out = 2.76773 - 19.828315 * kk + 80.709644 * kk**2 - 138.55152 * kk**3 + 81.218052 * kk**4
        elif kk <= 0.9:
            out = -4.901232 + 40.662806 * kk - 97.490286 * kk**2 + 94.029866 * kk**3 - 32.355711 * kk**4
        elif kk <= 1.31:
            out = 6.198765 - 19.558097 * kk + 23.186922 * kk**2 - 12.234627 * kk**3 + 2.423045 * kk**4
        else:
            out = 0.0
    return min(1.0, max(0.0, out))


def anderson_darling(x: np.ndarray) -> float:
    """p-value after Stephens (1986)."""
    n = len(x)
    if n < 8:
        raise ValueError("8 values at least")
    p = np.clip(_uniform(x), 1e-300, 1 - 1e-16)
    i = np.arange(1, n + 1)
    a = -n - ((2 * i - 1) / n * (np.log(p) + np.log1p(-p[::-1]))).sum()
    a *= 1 + 0.75 / n + 2.25 / n**2
    if a < 0.2:
        return 1 - math.exp(-13.436 + 101.14 * a - 223.73 * a * a)
    if a < 0.34:
        return 1 - math.exp(-8.318 + 42.796 * a - 59.938 * a * a)
    if a < 0.6:
        return math.exp(0.9177 - 4.279 * a - 1.38 * a * a)
    return math.exp(1.2937 - 5.709 * a + 0.0186 * a * a) if a < 153 else 0.0


def jarque_bera(x: np.ndarray) -> float:
    n = len(x)
    d = x - x.mean()
    m2 = (d**2).mean()
    b1, b2 = (d**3).mean() ** 2 / m2**3, (d**4).mean() / m2**2
    return chi2_sf(n * b1 / 6 + n * (b2 - 3) ** 2 / 24, 2)


TESTS = {"Shapiro-Wilk": shapiro_wilk, "Lilliefors": lilliefors, "Anderson-Darling": anderson_darling, "Jarque-Bera": jarque_bera, "Shapiro-Francia": shapiro_francia}


def test_normality(x, alpha: float = 0.05) -> bool:
    """Whether values pass as normal: not if of the tests that can be made all but two reject, which holds with two or fewer."""
    x = np.asarray([v for v in np.asarray(x, dtype=float) if not math.isnan(v)])
    if len(x) < 3:
        warnings.warn("too few values to test", stacklevel=2)
        return False
    sd = x.std(ddof=1)
    z = (x - x.mean()) / sd if sd > 0 else np.zeros_like(x)
    ps = []
    for f in TESTS.values():
        try:
            p = f(z)
        except (ValueError, ZeroDivisionError, FloatingPointError):
            continue
        if not math.isnan(p):
            ps.append(p)
    return not sum(p < alpha for p in ps) >= len(ps) - 2


test_normality.__test__ = False  # not a test of this library


def alpha_by_n(n: int) -> float:
    """The level for a group of n: 0.05 below 100, then ever smaller."""
    return 0.05 if n < 100 else 10 ** -(-math.log10(0.05) * math.exp(2 * (math.log10(n) - 2)))


@dataclass(frozen=True)
class VarTypes:
    factor_vars: list[str] = field(default_factory=list)
    exact_vars: list[str] = field(default_factory=list)
    nonnormal_vars: list[str] = field(default_factory=list)
    omit_vars: list[str] = field(default_factory=list)
    strata: str | None = None


def get_var_types(df: DataFrame, strata: str | None = None, norm_test_by_group: bool = True, omit_factor_above: int = 20, num_to_factor: int = 5) -> VarTypes:
    """How each variable is to be described: left out, as categories (with exact tests for small counts), or by median.

    One job counts distinct values, one counts categories by stratum, one tests normality: a task for
    each numeric variable and stratum. The tests take all values of a group in one task; beyond
    5000 values two of them do not apply.
    """
    cols = [c for c in df.columns if c != strata]
    types = dict(df.dtypes)
    row = df.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    distinct = {c: row[i] for i, c in enumerate(cols)}
    omit = [c for c in cols if distinct[c] == 0]
    is_num = lambda c: types[c] not in ("string", "boolean", "date")
    factors = [c for c in cols if c not in omit and (not is_num(c) or distinct[c] <= num_to_factor)]
    if many := [c for c in factors if not is_num(c) and distinct[c] > omit_factor_above]:
        warnings.warn(f"left out for their many levels: {many}", stacklevel=2)
        omit += many
        factors = [c for c in factors if c not in many]
    s = F.col(strata).cast("string") if strata else F.lit("")
    exact = []
    if factors:
        cells = df.select(s.alias("s"), F.explode(F.array(*[F.struct(F.lit(c).alias("v"), F.col(f"`{c}`").cast("string").alias("x")) for c in factors])).alias("e")).select("s", "e.*").where(F.col("s").isNotNull() & F.col("x").isNotNull()).groupBy("v", "s", "x").agg(F.count("*").alias("n")).toPandas()
        for c, g in cells.groupby("v"):
            t = g.pivot(index="x", columns="s", values="n").fillna(0).to_numpy()
            expected = t.sum(axis=1, keepdims=True) * t.sum(axis=0, keepdims=True) / t.sum()
            if (t.sum(axis=1) <= 5).any() or (strata and (expected <= 5).any()):
                exact.append(c)
    numeric = [c for c in cols if c not in omit and c not in factors]
    nonnormal: list[str] = []
    if numeric:
        by = s if norm_test_by_group else F.lit("")
        long = df.where(s.isNotNull()).select(by.alias("s"), F.explode(F.array(*[F.struct(F.lit(c).alias("v"), F.col(f"`{c}`").cast("double").alias("x")) for c in numeric])).alias("e")).select("s", "e.*").where(F.col("x").isNotNull())

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ok = test_normality(pdf["x"], alpha_by_n(len(pdf)))
            return pd.DataFrame({"v": [pdf["v"].iloc[0]], "ok": [bool(ok)]})

        bad = long.groupBy("v", "s").applyInPandas(one, "v string, ok boolean").where(~F.col("ok")).select("v").distinct().collect()
        nonnormal = [c for c in numeric if c in {r["v"] for r in bad}]
    return VarTypes(factors, [c for c in cols if c in exact], nonnormal, omit, strata)


def qq_show(x) -> pd.DataFrame:
    """theoretical and sample quantiles of scaled data."""
    x = np.sort(np.asarray([v for v in np.asarray(x, dtype=float) if not math.isnan(v)]))
    n = len(x)
    a = 0.375 if n <= 10 else 0.5
    return pd.DataFrame({"theoretical": [norm_ppf((i - a) / (n + 1 - 2 * a)) for i in range(1, n + 1)], "sample": (x - x.mean()) / x.std(ddof=1)})
