"""Table 1: characteristics of strata, with tests, missing values and pairwise comparisons."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinloom.functions.distributions import adjust, chi2_sf, f_sf, norm_sf, tukey_sf
from clinloom.operators.normality import VarTypes, get_var_types
from clinloom.operators.quantiles import quantiles

EXACT_DRAWS = 10_000


def welch(n: np.ndarray, mean: np.ndarray, var: np.ndarray) -> float:
    """One-way comparison of means without equal variances."""
    k, w = len(n), n / var
    m = (w * mean).sum() / w.sum()
    tmp = ((1 - w / w.sum()) ** 2 / (n - 1)).sum() / (k * k - 1)
    f = (w * (mean - m) ** 2).sum() / (k - 1) / (1 + 2 * (k - 2) * tmp)
    return f_sf(f, k - 1, 1 / (3 * tmp))


def chi_square(t: np.ndarray) -> float:
    """Of a table of counts; continuity-corrected for two by two."""
    t = t[t.sum(axis=1) > 0][:, t.sum(axis=0) > 0].astype(float)
    if min(t.shape) < 2:
        return math.nan
    e = t.sum(axis=1, keepdims=True) * t.sum(axis=0, keepdims=True) / t.sum()
    y = min(0.5, float(np.abs(t - e).min())) if t.shape == (2, 2) else 0.0
    return chi2_sf(float(((np.abs(t - e) - y) ** 2 / e).sum()), (t.shape[0] - 1) * (t.shape[1] - 1))


def fisher(t: np.ndarray, draws: int = EXACT_DRAWS, seed: int = 0) -> float:
    """Exact for two by two; else over seeded random tables of the same margins."""
    t = t[t.sum(axis=1) > 0][:, t.sum(axis=0) > 0].astype(int)
    if min(t.shape) < 2:
        return math.nan
    lf = lambda a: np.vectorize(math.lgamma)(np.asarray(a, dtype=float) + 1)
    r, c, n = t.sum(axis=1), t.sum(axis=0), int(t.sum())
    if t.shape == (2, 2):
        k = np.arange(max(0, c[0] - r[1]), min(r[0], c[0]) + 1)
        logp = -(lf(k) + lf(r[0] - k) + lf(c[0] - k) + lf(r[1] - c[0] + k))
        own = logp[k == t[0, 0]][0]
        p = np.exp(logp - logp.max())
        return float(p[logp <= own + 1e-7].sum() / p.sum())
    own = -lf(t).sum()
    rng = np.random.default_rng(seed)
    rows, cols = np.repeat(np.arange(len(r)), r), np.repeat(np.arange(len(c)), c)
    hit = 0
    for _ in range(draws):
        s = np.bincount(rows * len(c) + rng.permutation(cols), minlength=t.size)
        hit += -lf(s).sum() <= own + 1e-7
    return (hit + 1) / (draws + 1)


def rank_sums(df: DataFrame, value: str, strata: str) -> tuple[list, np.ndarray, np.ndarray, float, int]:
    """Strata, their sizes and rank sums, the tie term and n, from counts by distinct value: ranks are running counts."""
    from clinloom.operators.scan import running_sum

    d = df.where(F.col(f"`{value}`").isNotNull() & F.col(f"`{strata}`").isNotNull())
    cells = d.groupBy(F.col(f"`{value}`").cast("double").alias("x"), F.col(f"`{strata}`").cast("string").alias("s")).agg(F.count("*").alias("n"))
    by = cells.groupBy("x").agg(F.sum("n").alias("n"))
    ranked = running_sum(by, [], "x", ["n"]).select(F.col("x").alias("_x"), F.col("n").alias("t"), (F.col("cum_n") - (F.col("n") - 1) / 2).alias("rank"))
    tie = ranked.agg(F.sum(F.pow("t", 3) - F.col("t")).alias("t"), F.sum("t").alias("n")).first()
    rows = cells.join(ranked, F.col("x") == F.col("_x")).groupBy("s").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("r")).orderBy("s").collect()
    return [r["s"] for r in rows], np.array([r["n"] for r in rows], float), np.array([r["r"] for r in rows]), float(tie["t"] or 0), int(tie["n"] or 0)


def kruskal(n: np.ndarray, r: np.ndarray, tie: float, total: int) -> float:
    h = 12 / (total * (total + 1)) * (r**2 / n).sum() - 3 * (total + 1)
    return chi2_sf(h / (1 - tie / (total**3 - total)), len(n) - 1)


def dunn(n: np.ndarray, r: np.ndarray, tie: float, total: int) -> dict[tuple[int, int], float]:
    v = total * (total + 1) / 12 - tie / (12 * (total - 1))
    return {(i, j): 2 * norm_sf(abs(r[i] / n[i] - r[j] / n[j]) / math.sqrt(v * (1 / n[i] + 1 / n[j]))) for i, j in itertools.combinations(range(len(n)), 2)}


def games_howell(n: np.ndarray, mean: np.ndarray, var: np.ndarray) -> dict[tuple[int, int], float]:
    out = {}
    for i, j in itertools.combinations(range(len(n)), 2):
        a, b = var[i] / n[i], var[j] / n[j]
        df = (a + b) ** 2 / (a * a / (n[i] - 1) + b * b / (n[j] - 1))
        out[i, j] = tukey_sf(abs(mean[i] - mean[j]) / math.sqrt((a + b) / 2), len(n), df)
    return out


def show_p(p: float | None) -> str:
    return "" if p is None or math.isnan(p) else "<0.001" if p < 0.001 else f"{p:.3f}"


def summaries(df: DataFrame, numeric: list[str], strata: str | None) -> pd.DataFrame:
    """stratum (null: overall), variable, n, missing, mean, sd, q1, median, q3: one aggregate over the rollup of strata."""
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").cast("double").alias("x")) for c in numeric])
    s = F.col(f"`{strata}`").cast("string") if strata else F.lit(None).cast("string")
    long = df.select(s.alias("s"), F.explode(cells).alias("e")).select("s", "e.*")
    aggs = [F.count("x").alias("n"), F.count_if(F.col("x").isNull()).alias("missing"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd")]

    def by(rows: DataFrame, *keys: str) -> DataFrame:
        q = quantiles(rows, {"x": F.col("x")}, [0.25, 0.5, 0.75], list(keys)).withColumnRenamed("q_x", "q").drop("n_x")
        return rows.groupBy(*keys).agg(*aggs).join(q, list(keys))

    out = by(long, "variable").withColumn("s", F.lit(None).cast("string"))
    if strata:
        out = out.unionByName(by(long.where(F.col("s").isNotNull()), "variable", "s"))
    return out.select("s", "variable", "n", "missing", "mean", "sd", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")).toPandas()


def level_counts(df: DataFrame, factors: list[str], strata: str | None) -> pd.DataFrame:
    """stratum, variable, level (null: missing), n."""
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").cast("string").alias("level")) for c in factors])
    s = F.col(f"`{strata}`").cast("string") if strata else F.lit("")
    return df.select(s.alias("s"), F.explode(cells).alias("e")).select("s", "e.*").groupBy("s", "variable", "level").agg(F.count("*").alias("n")).toPandas()


def _order(levels) -> list[str]:
    try:
        return sorted(levels, key=float)
    except ValueError:
        return sorted(levels)


def baseline_table(df: DataFrame, strata: str | None = None, var_types: VarTypes | None = None, factor_vars: list[str] | None = None, exact_vars: list[str] | None = None, nonnormal_vars: list[str] | None = None, variables: list[str] | None = None, omit_missing_strata: bool = False, multiple_comparison_test: bool = True, p_adjust_method: str = "BH", seed: int = 0, smd: bool = False) -> dict[str, pd.DataFrame | None]:
    """baseline, missing and, with over two strata, pairwise: tables to print.

    All figures come from three aggregates in Spark; tests work on these summaries.
    """
    if var_types is None and factor_vars is None and nonnormal_vars is None:
        var_types = get_var_types(df, strata)
    vt = var_types or VarTypes(factor_vars or [], exact_vars or [], nonnormal_vars or [], [], strata)
    strata = strata or vt.strata
    if strata and omit_missing_strata:
        df = df.where(F.col(f"`{strata}`").isNotNull())
    names = [c for c in (variables or df.columns) if c != strata and c not in vt.omit_vars]
    factors = [c for c in names if c in vt.factor_vars]
    numeric = [c for c in names if c not in factors]
    num = summaries(df, numeric, strata) if numeric else pd.DataFrame(columns=["s", "variable"])
    cat = level_counts(df, factors, strata) if factors else pd.DataFrame(columns=["s", "variable", "level", "n"])
    size = {r["s"]: r["n"] for r in df.groupBy((F.col(f"`{strata}`").cast("string") if strata else F.lit("")).alias("s")).agg(F.count("*").alias("n")).collect()}
    groups = _order([g for g in size if g is not None]) if strata else []
    heads = ["Overall", *[f"{strata}: {g}" for g in groups]]
    total = sum(size.values())
    rows: list[dict] = [dict(zip(["", *heads], ["n", str(total), *[str(size[g]) for g in groups]])) | {"p": "", "test": ""}]
    missing, pairs = [], []
    for c in names:
        if c in numeric:
            mine = num[num["variable"] == c]
            cells = [mine[mine["s"].isna()].iloc[0], *[mine[mine["s"] == g].iloc[0] for g in groups]]
            non = c in vt.nonnormal_vars
            text = [f"{r['median']:.1f} [{r['q1']:.1f}, {r['q3']:.1f}]" if non else f"{r['mean']:.1f} ({r['sd']:.1f})" for r in cells]
            row = dict(zip(["", *heads], [f"{c} ({'median [IQR]' if non else 'mean (SD)'})", *text])) | {"p": "", "test": "nonnorm" if non else ""}
            n, mean, var = (np.array([float(r[k]) for r in cells[1:]]) for k in ("n", "mean", "sd"))
            var = var**2
            if len(groups) > 1:
                if non:
                    _, rn, rs, tie, k = rank_sums(df, c, strata)
                    row["p"] = show_p(kruskal(rn, rs, tie, k))
                    pw = dunn(rn, rs, tie, k) if len(groups) > 2 else {}
                else:
                    row["p"] = show_p(welch(n, mean, var))
                    pw = games_howell(n, mean, var) if len(groups) > 2 else {}
                if smd:
                    row["smd"] = np.mean([abs(mean[i] - mean[j]) / math.sqrt((var[i] + var[j]) / 2) for i, j in itertools.combinations(range(len(n)), 2)])
                p = list(pw.values()) if not non else adjust(list(pw.values()), p_adjust_method)
                pairs += [{"variable": c, "comparison": f"{groups[i]} vs {groups[j]}", "p": show_p(q)} for (i, j), q in zip(pw, p)]
            rows.append(row)
            missing.append(dict(zip(["", *heads], [c, *[f"{100 * r['missing'] / max(1, r['n'] + r['missing']):.1f}" for r in cells]])))
            continue
        mine = cat[cat["variable"] == c]
        have = mine[mine["level"].notna()]
        levels = _order(have["level"].unique())
        t = np.array([[have[(have["level"] == lv) & (have["s"] == g)]["n"].sum() for g in groups] for lv in levels], dtype=float).reshape(len(levels), len(groups))
        every = np.array([have[have["level"] == lv]["n"].sum() for lv in levels], dtype=float)
        show = lambda k: [f"{every[k]:.0f} ({100 * every[k] / max(1, every.sum()):.1f})", *[f"{t[k, j]:.0f} ({100 * t[k, j] / max(1, t[:, j].sum()):.1f})" for j in range(len(groups))]]
        exact = c in vt.exact_vars
        test = (lambda m: fisher(m, seed=seed)) if exact else chi_square
        p = show_p(test(t)) if len(groups) > 1 else ""
        if len(levels) == 2:
            rows.append(dict(zip(["", *heads], [f"{c} = {levels[1]} (%)", *show(1)])) | {"p": p, "test": "exact" if exact else ""})
        else:
            rows.append({"": f"{c} (%)"} | dict.fromkeys(heads, "") | {"p": p, "test": "exact" if exact else ""})
            rows += [dict(zip(["", *heads], [f"   {lv}", *show(k)])) | {"p": "", "test": ""} for k, lv in enumerate(levels)]
        if len(groups) > 2:
            combos = list(itertools.combinations(range(len(groups)), 2))
            ps = adjust([test(t[:, [i, j]]) for i, j in combos], p_adjust_method)
            pairs += [{"variable": c, "comparison": f"{groups[i]} vs {groups[j]}", "p": show_p(q)} for (i, j), q in zip(combos, ps)]
        gone = mine[mine["level"].isna()]
        share = lambda k, n: f"{100 * k / max(1, n):.1f}"
        missing.append(dict(zip(["", *heads], [c, share(gone["n"].sum(), total), *[share(gone[gone["s"] == g]["n"].sum(), size[g]) for g in groups]])))
    return {"baseline": pd.DataFrame(rows), "missing": pd.DataFrame(missing), "pairwise": pd.DataFrame(pairs) if multiple_comparison_test and len(groups) > 2 else None}
