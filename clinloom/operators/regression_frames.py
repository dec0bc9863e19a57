"""Regression tables, scans, forests and curves of a DataFrame of any size, over batched.fit_many().

What a table needs is found in few passes: the values of columns that have few, exact quantiles of numbers, and the fits of
all its models side by side. Only results, a few rows a model, come to the driver.

The kind of analysis follows from all rows that are complete in the specification's columns. A column that does not vary among a
model's rows is left out of it. Text of more than MAX_LEVELS values is no factor.
"""

from __future__ import annotations

import itertools
import warnings
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clinloom.functions.distributions import adjust, chi2_sf, norm_ppf
from clinloom.operators import batched as B
from clinloom.operators import models as M
from clinloom.operators.quantiles import quantiles
from clinloom.operators.regression import EFFECT, MAX_GROUPS, TRANSFORMS, ModelSpec, _text, remove_conflict

#: Values of a column that are listed at most; with more, a text is no factor.
MAX_LEVELS = 200


def few_values(df: DataFrame, columns: list[str], most: int = MAX_LEVELS) -> dict[str, list | None]:
    """Of each column its distinct values in order, without nulls; None if there are more than `most`.

    A task keeps no more than most + 1 values of a column, its least ones.
    """
    text = {c for c, t in df.dtypes if t == "string"}
    one = [(F.col(f"`{c}`") if c in text else F.col(f"`{c}`").cast("double")).alias(f"c{i}") for i, c in enumerate(columns)]

    def run(batches):
        have: dict[int, pa.Array] = {}
        for b in batches:
            for i in range(len(columns)):
                v = pc.unique(pc.drop_null(b.column(i)))
                v = pc.unique(pa.concat_arrays([have[i], v])) if i in have else v
                have[i] = v.take(pc.sort_indices(v))[: most + 1]
        for i, v in have.items():
            words = columns[i] in text
            none = pa.nulls(len(v), pa.float64() if words else pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), none if words else v, v if words else none], names=["i", "num", "txt"])

    got = df.select(*one).mapInArrow(run, "i int, num double, txt string").distinct()
    nth = F.row_number().over(Window.partitionBy("i").orderBy("num", "txt"))  # at most so many rows a task and column
    out: dict[str, list] = {c: [] for c in columns}
    for r in got.withColumn("nth", nth).where(F.col("nth") <= most + 1).orderBy("i", "nth").collect():
        c = columns[r["i"]]
        out[c].append(r["txt"] if c in text else r["num"])
    return {c: None if len(v) > most else v for c, v in out.items()}


class Study:
    """The rows that are complete in the specification's columns (and, if asked, in all), and what is known of their columns: few values, quantiles (more; None: no quantiles)."""

    def __init__(self, df: DataFrame, spec: ModelSpec, columns: list[str], complete: bool = True, more: tuple[float, ...] | None = M.KNOTS[4]):
        used = list(dict.fromkeys([*spec.columns, *columns]))
        self.spec, kinds = spec, dict(df.dtypes)
        need = used if complete else spec.columns
        self.df = df.select(*[F.col(f"`{c}`") for c in used]).where(" AND ".join(f"`{c}` IS NOT NULL" for c in need))
        self.text = {c for c in used if kinds[c] == "string"}
        self.boolean = {c for c in used if kinds[c] == "boolean"}
        self.few = few_values(self.df, used)
        self.levels = {c: self.few[c] or [] for c in self.text}
        if bad := [c for c in (*spec.covars, spec.y) if c in self.text and self.few[c] is None]:
            raise ValueError(f"too many values for a factor: {bad}")
        numbers = [c for c in dict.fromkeys(columns) if c not in self.text]
        self.probs = sorted({0.0, 0.5, 1.0, *(more or ())})
        self.at: dict[str, dict[float, float]] = {}
        if numbers and more is not None:
            r = quantiles(self.df, {str(i): F.col(f"`{c}`") for i, c in enumerate(numbers)}, self.probs).first()
            self.at = {c: dict(zip(self.probs, r[f"q_{i}"])) for i, c in enumerate(numbers)}

    def kind(self) -> str:
        return "cox" if self.spec.time else "logistic" if len(self.few[self.spec.y] or [0] * 9) == 2 else "linear"

    def outcome(self) -> B.Term:
        y, values = self.spec.y, self.few[self.spec.y]
        if values is not None and len(values) == 2:
            return B.Term("is", y, (1.0 if y in self.text else values[1],))
        return B.Term("value", y)

    def numeric(self, c: str) -> bool:
        return c not in self.text and c not in self.boolean

    def many(self, c: str, groups: int = MAX_GROUPS) -> bool:
        return self.few[c] is None or len(self.few[c]) > groups

    def design(self, c: str) -> tuple[list[str], list[B.Term]]:
        """A column's part of a model: itself, or an indicator for each level but the first."""
        if c not in self.text:
            return [c], [B.Term("value", c)]
        if self.few[c] is None:
            raise ValueError(f"{c} has too many values for a factor")
        return [f"{c}{v}" for v in self.few[c][1:]], [B.Term("is", c, (float(i),)) for i in range(1, len(self.few[c]))]

    def spline(self, c: str, knots: int, at: dict[float, float] | None = None) -> tuple[list[str], list[B.Term]]:
        if not self.numeric(c):
            raise ValueError("a spline needs numbers")
        t = tuple((at or self.at[c])[p] for p in M.KNOTS[knots])
        return [c + "'" * i for i in range(knots - 1)], [B.Term("rcs", c, (t, i)) for i in range(knots - 1)]

    def factor(self, c: str, groups: int = MAX_GROUPS, median: float | None = None) -> tuple[list[str], list[B.Term]]:
        """Names of all levels, and the indicator of each; numbers of many values are split at their median."""
        if c in self.text:
            return list(map(str, self.few[c] or [])), [B.Term("is", c, (float(i),)) for i in range(len(self.few[c] or []))]
        if self.many(c, groups):
            mid = self.at[c][0.5] if median is None else median
            return ["Low", "High"], [B.Term("bin", c, ((mid,), False, i)) for i in range(2)]
        values = [bool(v) for v in self.few[c]] if c in self.boolean else [int(v) if float(v).is_integer() else v for v in self.few[c]]
        return list(map(str, values)), [B.Term("is", c, (float(v),)) for v in self.few[c]]

    def model(self, parts: list[tuple[list[str], list[B.Term]]], needs: list[str], covars: tuple[str, ...] | None = None, where: B.Term | None = None, cluster: bool = True) -> B.Model:
        parts = [*parts, *[self.design(c) for c in (self.spec.covars if covars is None else covars)]]
        names, terms = tuple(n for p in parts for n in p[0]), tuple(t for p in parts for t in p[1])
        s = self.spec
        return B.Model(self.kind(), self.outcome(), names, terms, tuple(sorted({c for c in (*s.columns, *needs) if c != s.cluster})), where, s.time, s.time2, s.cluster if cluster else None)

    def fit(self, models: list[B.Model], **more) -> list[M.Fit | None]:
        return B.fit_many(self.df, models, self.levels, **more)


def _rows(fit: M.Fit | None, names: list[str]) -> list[dict]:
    """Rows of the table for these terms; terms left out of the model have none of the numbers."""
    table = {} if fit is None else {r["term"]: r for r in fit.table(limits=fit.extra.get("limits"))}
    empty = dict.fromkeys(("estimate", "std_error", "statistic", "p_value", "conf_low", "conf_high"))
    return [table.get(n, {"term": n} | empty) for n in names]


def _wald(fit: M.Fit, names: list[str]) -> float | None:
    at = [fit.names.index(n) for n in names if n in fit.names]
    return fit.wald(at) if at else None


def regression_fit(df: DataFrame, spec: ModelSpec, predictor: str, rcs_knots: int = 0, returned: str = "predictor_split", profile: bool = True) -> list[dict]:
    """Rows of the model's table. returned: full, predictor_split (a row a coefficient), predictor_combined
    (several coefficients, or a spline, with one joint p-value). Limits of logistic models are those of the profile likelihood."""
    if returned not in ("full", "predictor_split", "predictor_combined"):
        raise ValueError("unknown form of result")
    s = Study(df, spec, [predictor], more=M.KNOTS.get(rcs_knots, ()))
    part = s.spline(predictor, rcs_knots) if rcs_knots else s.design(predictor)
    m = s.model([part], [predictor])
    joint = returned == "predictor_combined" and (rcs_knots or len(part[0]) > 1)
    wanted = list(m.names) if returned == "full" else part[0]
    limits = {0: wanted} if profile and m.kind == "logistic" and not spec.cluster and not rcs_knots and not joint else None
    (fit,) = s.fit([m], limits=limits)
    if fit is None:
        raise ValueError("no complete row")
    if joint:
        row = {"term": predictor, "p_value": _wald(fit, part[0])}
        return [row | {"nonlinear_p": _wald(fit, part[0][1:])} if rcs_knots else row]
    return _rows(fit, ["(Intercept)", *wanted] if returned == "full" and fit.kind == "linear" else wanted)


def regression_scan(df: DataFrame, spec: ModelSpec, predictors: list[str] | None = None, num_to_factor: int = MAX_GROUPS, p_adjust_method: str = "BH") -> pd.DataFrame:
    """Each predictor as it is, as a logarithm, in categories and as a spline; by p of the first.

    All models are fitted side by side; models of fewer than 10 rows are not. The result has a row a predictor, so it is made on the driver.
    """
    predictors = [p for p in (predictors or df.columns) if p not in (spec.y, spec.time, spec.time2, spec.cluster)]
    s = Study(df, spec, predictors, complete=False)
    plan: list[tuple[str, str, list[str], B.Model]] = []
    for p in predictors:
        covars = tuple(c for c in spec.covars if c != p)
        numeric = s.numeric(p)
        if p in s.text and s.few[p] is None:
            warnings.warn(f"{p} has too many values for a factor", stacklevel=2)
            continue
        forms = {"original": s.design(p)}
        if numeric and s.at[p][0.0] is not None:
            if s.at[p][0.0] > 0:
                forms["logarithm"] = [p], [B.Term("log", p)]
            if s.many(p, num_to_factor):
                forms["categorized"] = [f"{p}High"], [B.Term("bin", p, ((s.at[p][0.5],), False, 1))]
                forms["rcs"] = s.spline(p, 4)
            else:
                values = sorted(s.few[p], key=str)
                forms["categorized"] = [f"{p}{v}" for v in values[1:]], [B.Term("is", p, (v,)) for v in values[1:]]
        plan += [(p, t, part[0], s.model([part], [p], covars)) for t, part in forms.items()]
    fits = {(p, t): (names, f) for (p, t, names, _), f in zip(plan, s.fit([m for *_, m in plan], least=10))}
    counts = {p: f.n for (p, t), (_, f) in fits.items() if f and t == "original"}
    if rest := [p for p in predictors if p not in counts]:
        counts |= {p: n for p, (n, _) in zip(rest, B.tally(s.df, [s.model([], [p], ()) for p in rest], s.levels))}
    out = []
    for p in predictors:
        r = {"predictor": p, "nvalid": counts[p]}
        for t in TRANSFORMS[:3]:
            names, f = fits.get((p, t), ([], None))
            row = _rows(f, names)[0] if f and len(names) == 1 else {}
            r |= {f"{t}.effect": row.get("estimate"), f"{t}.p": row.get("p_value") if len(names) == 1 else _wald(f, names) if f else None}
        names, f = fits.get((p, "rcs"), ([], None))
        out.append(r | {"rcs.overall.p": _wald(f, names) if f else None, "rcs.nonlinear.p": _wald(f, names[1:]) if f else None})
    res = pd.DataFrame(out).sort_values("original.p", kind="stable", na_position="last").reset_index(drop=True)
    ps = [f"{t}.p" for t in TRANSFORMS[:3]] + ["rcs.overall.p"]
    for c in ps:
        res[c] = res[c].astype(float)
        res[c.replace(".p", ".padj")] = adjust([None if pd.isna(v) else float(v) for v in res[c]], p_adjust_method)
    best = [None if r[ps].isna().all() else min((v, i) for i, v in enumerate(r[ps]) if not pd.isna(v))[1] for _, r in res.iterrows()]
    res["best.var.trans"] = [None if i is None else (*TRANSFORMS[:3], "rcs.overall")[i] for i in best]
    return res


def _product(a: list[B.Term], b: list[B.Term]) -> tuple[list[str], list[B.Term]]:
    pairs = list(itertools.product(a, b))
    return [f"x{i}" for i in range(len(pairs))], [B.Term("times", "", p) for p in pairs]


def _interaction(s: Study, predictor: str, group: tuple[list[str], list[B.Term]], needs: list[str], part: tuple[list[str], list[B.Term]], covars: tuple[str, ...]) -> list[B.Model]:
    """The models without and with the product of predictor and group."""
    b = [f"g{n}" for n in group[0][1:]], group[1][1:]
    return [s.model(parts, needs, covars, cluster=False) for parts in ([part, b], [part, b, _product(part[1], b[1])])]


def _ratio(less: M.Fit | None, more: M.Fit | None, df: int) -> float | None:
    return chi2_sf(max(0.0, 2 * (more.loglik - less.loglik)), df) if less and more and df else None


def interaction_p_value(df: DataFrame, spec: ModelSpec, predictor: str, group_var: str, rcs_knots: int = 0) -> float | None:
    """Likelihood ratio of the model with the product of predictor and group against that without."""
    covars = remove_conflict(spec.covars, (predictor, group_var))
    s = Study(df, replace(spec, cluster=None, covars=covars), [predictor, group_var], more=M.KNOTS.get(rcs_knots, ()))
    part = s.spline(predictor, rcs_knots) if rcs_knots else s.design(predictor)
    group = s.factor(group_var)
    return _ratio(*s.fit(_interaction(s, predictor, group, [predictor, group_var], part, covars)), len(part[1]) * (len(group[1]) - 1))


def interaction_scan(df: DataFrame, spec: ModelSpec, predictors: list[str] | None = None, group_vars: list[str] | None = None, try_rcs: bool = True, p_adjust_method: str = "BH") -> pd.DataFrame:
    """All ordered pairs of a predictor and another variable as group; by p of the straight line.

    Medians and knots are those of the rows that are complete in both; all models are fitted side by side.
    """
    used = {spec.y, spec.time, spec.time2, spec.cluster}
    predictors = predictors or [c for c in df.columns if c not in used]
    group_vars = group_vars or [c for c in df.columns if c not in used]
    pairs = [(p, g) for p, g in itertools.product(predictors, group_vars) if p != g]
    own = replace(spec, cluster=None)
    s = Study(df, own, [*predictors, *group_vars], complete=False)
    numbers = {x: y for p, g in pairs for x, y in (((p, g), None), ((g, p), None)) if s.numeric(x[0])}
    probs = (0.5, *M.KNOTS[4])
    at: dict = {}
    if numbers:
        both = {str(i): F.when(F.col(f"`{y}`").isNotNull(), F.col(f"`{x}`")) for i, (x, y) in enumerate(numbers)}
        r = quantiles(s.df, both, list(probs)).first()
        at = {k: dict(zip(probs, r[f"q_{i}"])) for i, k in enumerate(numbers)}
    asked, models = [], []
    for p, g in pairs:
        if any(c in s.text and s.few[c] is None for c in (p, g)):
            warnings.warn(f"{p} by {g}: too many values for a factor", stacklevel=2)
            continue
        covars = tuple(c for c in spec.covars if c not in (p, g))
        group = s.factor(g, median=at.get((g, p), {}).get(0.5))
        forms = {"linear": s.design(p)}
        if try_rcs and s.numeric(p) and s.many(p, 10) and at[p, g][0.5] is not None:
            forms["rcs"] = s.spline(p, 4, at[p, g])
        for form, part in forms.items():
            asked.append((p, g, form, len(part[1]) * (len(group[1]) - 1)))
            models += _interaction(s, p, group, [p, g], part, covars)
    fits = s.fit(models, least=10)
    counts = B.tally(s.df, [s.model([], [p, g], (), cluster=False) for p, g in pairs], s.levels)
    rows = {(p, g): {"predictor": p, "group.by": g, "nvalid": n, "linear.p": None, "rcs.p": None} for (p, g), (n, _) in zip(pairs, counts)}
    for (p, g, form, k), less, more in zip(asked, fits[::2], fits[1::2]):
        rows[p, g][f"{form}.p"] = _ratio(less, more, k)
    res = pd.DataFrame(list(rows.values())).sort_values(["linear.p", "predictor", "group.by"], kind="stable", na_position="last").reset_index(drop=True)
    for c in ("linear", "rcs"):
        res[f"{c}.p"] = res[f"{c}.p"].astype(float)
        res[f"{c}.padj"] = adjust([None if pd.isna(v) else float(v) for v in res[f"{c}.p"]], p_adjust_method)
    return res if try_rcs else res.drop(columns=["rcs.p", "rcs.padj"])


def regression_forest(df: DataFrame, spec: ModelSpec, model_vars: dict[str, list[str]] | list[str], as_univariate: bool = False, show_vars: list[str] | None = None, est_nsmall: int = 2) -> pd.DataFrame:
    """model, variable, level, estimate, lower, upper, p, text of several models on common complete rows."""
    sets = model_vars if isinstance(model_vars, dict) else {"Univariate" if as_univariate else "Model": list(model_vars)}
    s = Study(df, spec, list(dict.fromkeys(v for vs in sets.values() for v in vs)), more=None)
    asked = [(name, fitted) for name, names in sets.items() for fitted in ([[v] for v in names] if as_univariate else [names])]
    rows = []
    for (name, fitted), fit in zip(asked, s.fit([s.model([s.design(v) for v in fitted], fitted) for _, fitted in asked])):
        for v in fitted:
            if show_vars and v not in show_vars:
                continue
            if v in s.text:
                rows.append({"model": name, "variable": v, "level": s.few[v][0], "estimate": None, "lower": None, "upper": None, "p": None, "text": "Reference"})
            for r in _rows(fit, s.design(v)[0]):
                rows.append({"model": name, "variable": v, "level": r["term"][len(v) :] or None, "estimate": r["estimate"], "lower": r["conf_low"], "upper": r["conf_high"], "p": r["p_value"], "text": _shown(r, est_nsmall)})
    return pd.DataFrame(rows)


def _shown(r: dict, nsmall: int = 2) -> str | None:
    return None if r["estimate"] is None else _text(r, nsmall)


def regression_basic_results(df: DataFrame, spec: ModelSpec, x: str, model_covs: dict[str, list[str]] | None = None, pers: tuple[float, ...] = (0.1, 10, 100), factor_breaks: list[float] | None = None, quantile_breaks: tuple[float, ...] | None = None, ref_levels: str = "lowest") -> pd.DataFrame:
    """One predictor in many encodings by several models: item, level, n, events, per model estimate text and p; trend p for over two levels."""
    model_covs = {"Crude": []} | (model_covs or {})
    more = list(dict.fromkeys(c for cs in model_covs.values() for c in cs))
    s = Study(df, replace(spec, covars=tuple(dict.fromkeys([*spec.covars, *more]))), [x], more=(0.25, 0.75, *(quantile_breaks or ())))
    # an item: its levels (none for a number), the terms of all levels, and the term that numbers them
    enc: dict[str, tuple[list[str] | None, list[B.Term], B.Term | None]] = {}
    bins = lambda names, inner, right: (names, [B.Term("bin", x, (tuple(inner), right, i)) for i in range(len(names))], B.Term("bin", x, (tuple(inner), right)))

    def by_quantiles(probs: list[float]):
        edges = sorted({s.at[x][p] for p in (0.0, *probs, 1.0)})
        return bins([str(c) for c in pd.cut(pd.Series(edges[:1]), edges, include_lowest=True).cat.categories], edges[1:-1], True)

    if s.numeric(x):
        sd = s.df.agg(F.stddev_samp(F.col(f"`{x}`").cast("double"))).first()[0]
        enc["Continuous"] = None, [B.Term("value", x)], None
        enc |= {f"Continuous, per {k:g}": (None, [B.Term("per", x, (float(k),))], None) for k in pers}
        enc["Continuous, per 1 SD"] = None, [B.Term("per", x, (sd,))], None
        if s.at[x][0.0] > 0:
            enc["Continuous, logarithm"] = None, [B.Term("log", x)], None
        enc["Grouped by Quartiles"] = by_quantiles([0.25, 0.5, 0.75])
        enc["Grouped by Median Value"] = bins(["Low", "High"], [s.at[x][0.5]], False)
        if factor_breaks:
            edges = [-np.inf, *factor_breaks, np.inf]
            enc["Grouped by Clinical Value"] = bins([str(c) for c in pd.cut(pd.Series([0.0]), edges, right=False).cat.categories], factor_breaks, False)
        if quantile_breaks:
            enc["Grouped by Quantiles"] = by_quantiles(list(quantile_breaks))
    else:
        names, terms = s.factor(x)
        enc["Factor"] = names, terms, B.Term("value", x)
    if ref_levels == "highest":
        enc = {k: (n[::-1], t[::-1], c) if n else (n, t, c) for k, (n, t, c) in enc.items()}
    count_models = [s.model([], [x], (), where=t) for n, terms, _ in enc.values() for t in (terms if n else [None])]
    counts = iter(B.tally(s.df, count_models, s.levels))
    models = []
    for n, terms, code in enc.values():
        for covs in model_covs.values():
            covars = (*spec.covars, *covs)
            models.append(s.model([(n[1:], terms[1:]) if n else ([x], terms)], [x], covars))
            if n and len(n) > 2:
                models.append(s.model([([x], [code])], [x], covars))
    fits, rows = iter(s.fit(models)), []
    for item, (n, _, _) in enc.items():
        block = [{"item": item, "level": lv, "n": (c := next(counts))[0], "events": c[1]} for lv in (n or [None])]
        trend = {"item": item, "level": "P for trend", "n": None, "events": None} if n and len(n) > 2 else None
        for name in model_covs:
            got = _rows(next(fits), n[1:] if n else [x])
            if n:
                block[0] |= {f"{name}.estimate": "1 (Reference)", f"{name}.p": None}
            for b, r in zip(block[1:] if n else block, got):
                b |= {f"{name}.estimate": _shown(r), f"{name}.p": r["p_value"]}
            if trend is not None:
                trend[f"{name}.p"] = _rows(next(fits), [x])[0]["p_value"]
                # a higher reference turns the order of levels round, not the p-value
        rows += block + ([trend] if trend else [])
    return pd.DataFrame(rows)


def subgroup_forest(df: DataFrame, spec: ModelSpec, x: str, subgroup_vars: list[str], standardize_x: bool = False, est_nsmall: int = 2) -> pd.DataFrame:
    """variable, level, n, percent, estimate, lower, upper, p, interaction_p: overall, then by level of each variable."""
    s = Study(df, spec, [x, *subgroup_vars], more=())
    needs, part = [x, *subgroup_vars], s.design(x)
    if standardize_x:
        r = s.df.agg(F.avg(F.col(f"`{x}`").cast("double")).alias("m"), F.stddev_samp(F.col(f"`{x}`").cast("double")).alias("s")).first()
        part = [x], [B.Term("shift", x, (r["m"], r["s"]))]
    models, plan = [s.model([part], needs)], []
    for v in subgroup_vars:
        covars, group = remove_conflict(spec.covars, (v,)), s.factor(v)
        plan.append((v, group))
        models += _interaction(s, x, group, needs, part, remove_conflict(covars, (x,), warn=False))
        models += [s.model([part], needs, covars, where=t) for t in group[1]]
    fits = iter(s.fit(models))
    counts = iter(B.tally(s.df, [s.model([], needs, ())] + [s.model([], needs, (), where=t) for _, g in plan for t in g[1]], s.levels))

    def effect(fit: M.Fit | None) -> dict:
        r = _rows(fit, part[0][:1])[0]
        return {"estimate": r["estimate"], "lower": r["conf_low"], "upper": r["conf_high"], "p": r["p_value"], "text": _shown(r, est_nsmall)}

    total = next(counts)[0]
    rows = [{"variable": "Overall", "level": None, "n": total, "percent": 100.0, "interaction_p": None} | effect(next(fits))]
    for v, group in plan:
        p = _ratio(next(fits), next(fits), len(part[1]) * (len(group[1]) - 1))
        rows.append({"variable": v, "level": None, "n": None, "percent": None, "interaction_p": p})
        for name in group[0]:
            n = next(counts)[0]
            rows.append({"variable": v, "level": name, "n": n, "percent": round(100 * n / total, 1), "interaction_p": None} | effect(next(fits)))
    return pd.DataFrame(rows)


def predictor_effect_plot(df: DataFrame, spec: ModelSpec, x: str, method: str = "auto", knot: int | None = 4, ref: str | float = "x_median", points: int = 100, breaks: int = 20) -> dict:
    """details (type, n, reference, p values, AIC by knots), curve (x, yhat, lower, upper) against the reference, histogram."""
    s = Study(df, spec, [x], more=tuple(p for k in ((3, 4, 5, 6, 7) if knot is None else (knot,)) for p in M.KNOTS[k]))
    if method == "auto":
        method = "rcs" if s.numeric(x) and s.many(x) else "categorical"
    kind = s.kind()
    scale = np.exp if kind != "linear" else (lambda v: v)
    if method == "categorical":
        names, terms = s.factor(x, groups=MAX_LEVELS)
        (fit,) = s.fit([s.model([(names[1:], terms[1:])], [x])])
        rows = [{"x": names[0], "yhat": float(scale(0.0)), "lower": float(scale(0.0)), "upper": float(scale(0.0))}]
        rows += [{"x": r["term"], "yhat": r["estimate"], "lower": r["conf_low"], "upper": r["conf_high"]} for r in _rows(fit, names[1:])]
        return {"details": {"type": kind, "effect": EFFECT[kind], "method": method, "n": fit.n, "p_overall": _wald(fit, names[1:])}, "curve": pd.DataFrame(rows), "histogram": None}
    tried = {k: s.spline(x, k) for k in ((3, 4, 5, 6, 7) if knot is None else (knot,))} if method == "rcs" else {0: s.design(x)}
    fits = dict(zip(tried, s.fit([s.model([part], [x]) for part in tried.values()])))
    aic = {k: f.aic for k, f in fits.items()} if knot is None and method == "rcs" else {}
    best = min(aic, key=aic.get) if aic else next(iter(tried))
    fit, (labels, terms) = fits[best], tried[best]
    basis = (lambda u: M.spline_basis(u, terms[0].args[0])) if method == "rcs" else (lambda u: u[:, None])
    lo, hi = s.at[x][0.0], s.at[x][1.0]
    grid, at = np.linspace(lo, hi, points), [fit.names.index(n) for n in labels]
    if ref == "x_median":
        r = s.at[x][0.5]
    elif ref == "x_mean":
        r = s.df.agg(F.avg(F.col(f"`{x}`").cast("double"))).first()[0]
    elif ref == "ratio_min":
        r = float(grid[int((basis(grid) @ fit.beta[at]).argmin())])
    else:
        r = float(ref)
    diff, z = basis(grid) - basis(np.array([r])), norm_ppf(0.975)
    y, se = _line(diff, fit, at)
    edges = np.linspace(lo, hi, breaks + 1)
    details = {"type": kind, "effect": EFFECT[kind], "method": method, "knot": best or None, "n": fit.n, "reference": float(r), "p_overall": _wald(fit, labels), "p_nonlinear": _wald(fit, labels[1:]) if len(labels) > 1 else None, "aic": aic}
    return {"details": details, "curve": pd.DataFrame({"x": grid, "yhat": scale(y), "lower": scale(y - z * se), "upper": scale(y + z * se)}), "histogram": pd.DataFrame({"left": edges[:-1], "right": edges[1:], "n": B.histogram(s.df, x, edges)})}


def _line(rows: np.ndarray, fit: M.Fit, at: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return rows @ fit.beta[at], np.sqrt(np.clip(np.einsum("ij,jk,ik->i", rows, fit.cov[np.ix_(at, at)], rows), 0, None))


def interaction_plot(df: DataFrame, spec: ModelSpec, predictor: str, group_var: str, points: int = 100) -> pd.DataFrame:
    """form (linear, rcs), group, x, yhat, lower, upper, p: the linear predictor by group on a grid; of hazards, about the columns' means."""
    covars = remove_conflict(spec.covars, (predictor, group_var), warn=False)
    s = Study(df, replace(spec, cluster=None), [predictor, group_var])
    group, forms = s.factor(group_var), {"linear": s.design(predictor)}
    if s.many(predictor, 10):
        forms["rcs"] = s.spline(predictor, 4)
    models = [m for part in forms.values() for m in _interaction(s, predictor, group, [predictor, group_var], part, covars)]
    fits, frames = s.fit(models), []
    grid = np.linspace(s.at[predictor][0.0], s.at[predictor][1.0], points)
    for (form, part), less, more in zip(forms.items(), fits[::2], fits[1::2]):
        k, others = len(part[1]), len(group[1]) - 1
        p, names = _ratio(less, more, k * others), [*part[0], *(f"g{n}" for n in group[0][1:]), *(f"x{i}" for i in range(k * others))]
        curve = M.spline_basis(grid, part[1][0].args[0]) if form == "rcs" else grid[:, None]
        scaled, base = more.extra["scaled"], [i for i, n in enumerate(more.names) if n == "(Intercept)"]
        mean = dict(zip(scaled.model.names, scaled.mean))
        have = [n for n in names if n in more.names]
        for j, level in enumerate(group[0]):
            ind = np.tile([float(j == q + 1) for q in range(others)], (points, 1))
            row = np.column_stack([curve, ind, *[curve[:, [a]] * ind[:, [b]] for a in range(k) for b in range(others)]])[:, [names.index(n) for n in have]]
            row = row if base else row - np.array([mean[n] for n in have])
            y, se = _line(np.column_stack([np.ones((points, len(base))), row]), more, [*base, *(more.names.index(n) for n in have)])
            frames.append(pd.DataFrame({"form": form, "group": level, "x": grid, "yhat": y, "lower": y - 1.959964 * se, "upper": y + 1.959964 * se, "p": p}))
    return pd.concat(frames, ignore_index=True)
