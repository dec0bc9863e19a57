"""Linear, logistic and proportional-hazards models.

Kernels work on arrays in one process, for the many small fits of a scan. fit_*() work on
a DataFrame of any size: each step sums what the step needs in every partition, and only
these sums, a few numbers squared, reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinloom.functions.distributions import chi2_sf, f_sf, norm_ppf, norm_sf, t_ppf, t_sf2

#: Places of spline knots, as shares of the values, by number of knots.
KNOTS = {3: (0.1, 0.5, 0.9), 4: (0.05, 0.35, 0.65, 0.95), 5: (0.05, 0.275, 0.5, 0.725, 0.95), 6: (0.05, 0.23, 0.41, 0.59, 0.77, 0.95), 7: (0.025, 0.1833, 0.3417, 0.5, 0.6583, 0.8167, 0.975)}


@dataclass
class Fit:
    kind: str
    names: list[str]
    beta: np.ndarray
    cov: np.ndarray
    loglik: float
    n: int
    df_resid: float = math.inf
    extra: dict = field(default_factory=dict)

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.diag(self.cov))

    def table(self, exponentiate: bool | None = None, level: float = 0.95, limits: dict[str, tuple[float, float]] | None = None) -> list[dict]:
        """term, estimate, std_error, statistic, p_value, conf_low, conf_high."""
        exp = self.kind != "linear" if exponentiate is None else exponentiate
        rows = []
        for i, name in enumerate(self.names):
            b, s = float(self.beta[i]), float(self.se[i])
            z = b / s if s > 0 else math.nan
            if self.kind == "linear":
                p, q = t_sf2(z, self.df_resid), t_ppf(0.5 + level / 2, self.df_resid)
            else:
                p, q = 2 * norm_sf(abs(z)), norm_ppf(0.5 + level / 2)
            lo, hi = (limits or {}).get(name, (b - q * s, b + q * s))
            f = math.exp if exp else (lambda v: v)
            rows.append({"term": name, "estimate": f(b), "std_error": s, "statistic": z, "p_value": p, "conf_low": f(lo), "conf_high": f(hi)})
        return rows

    def wald(self, terms: list[int]) -> float:
        """The p-value of several coefficients being nought together."""
        b, v = self.beta[terms], self.cov[np.ix_(terms, terms)]
        stat = float(b @ np.linalg.pinv(v) @ b)
        return f_sf(stat / len(terms), len(terms), self.df_resid) if self.kind == "linear" else chi2_sf(stat, len(terms))

    @property
    def aic(self) -> float:
        return 2 * (len(self.beta) + (self.kind == "linear")) - 2 * self.loglik


def spline_basis(x: np.ndarray, knots) -> np.ndarray:
    """Restricted cubic spline: the value and one curve for each knot but the last two, straight beyond the outer knots."""
    t = np.asarray(knots, dtype=float)
    k, scale = len(t), (t[-1] - t[0]) ** 2
    up = lambda v: np.clip(v, 0, None) ** 3
    cols = [x]
    for j in range(k - 2):
        cols.append((up(x - t[j]) - up(x - t[-2]) * (t[-1] - t[j]) / (t[-1] - t[-2]) + up(x - t[-1]) * (t[-2] - t[j]) / (t[-1] - t[-2])) / scale)
    return np.column_stack(cols)


def spline_knots(x: np.ndarray, k: int = 4) -> np.ndarray:
    return np.quantile(x, KNOTS[k])


def _sandwich(cov: np.ndarray, scores: np.ndarray, cluster: np.ndarray | None) -> np.ndarray:
    if cluster is not None:
        _, at = np.unique(cluster, return_inverse=True)
        by = np.zeros((at.max() + 1, scores.shape[1]))
        np.add.at(by, at, scores)
        scores = by
    return cov @ (scores.T @ scores) @ cov


def ols(x: np.ndarray, y: np.ndarray, names: list[str], cluster: np.ndarray | None = None) -> Fit:
    g = np.linalg.pinv(x.T @ x)
    b = g @ (x.T @ y)
    e = y - x @ b
    n, p = x.shape
    s2 = float(e @ e) / (n - p)
    cov = _sandwich(g, x * e[:, None], cluster) if cluster is not None else g * s2
    ll = -n / 2 * (math.log(2 * math.pi) + math.log(float(e @ e) / n) + 1)
    return Fit("linear", names, b, cov, ll, n, n - p, {"sigma2": s2})


def _logit_terms(x: np.ndarray, y: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    eta = x @ b
    p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
    ll = float((y * eta - np.logaddexp(0, eta)).sum())
    return ll, x.T @ (y - p), (x * (p * (1 - p))[:, None]).T @ x


def newton(step: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], p: int, rounds: int = 50, tol: float = 1e-10, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """The maximum of a log likelihood of which step gives value, gradient and information; steps that worsen it are halved."""
    b = np.zeros(p) if start is None else start.copy()
    ll, g, h = step(b)
    for _ in range(rounds):
        d = np.linalg.pinv(h) @ g
        for _ in range(30):
            new = step(b + d)
            if np.isfinite(new[0]) and new[0] >= ll - 1e-9:
                break
            d = d / 2
        b, old = b + d, ll
        ll, g, h = new
        if abs(ll - old) < tol * (abs(ll) + tol):
            break
    return b, np.linalg.pinv(h), ll


def logistic(x: np.ndarray, y: np.ndarray, names: list[str], cluster: np.ndarray | None = None) -> Fit:
    b, cov, ll = newton(lambda v: _logit_terms(x, y, v), x.shape[1])
    if cluster is not None:
        p = 1 / (1 + np.exp(-(x @ b)))
        cov = _sandwich(cov, x * (y - p)[:, None], cluster)
    return Fit("logistic", names, b, cov, ll, len(y))


def profile_limits(x: np.ndarray, y: np.ndarray, fit: Fit, j: int, level: float = 0.95) -> tuple[float, float]:
    """Where the likelihood, maximised over the other coefficients, falls by half the chi-square quantile."""
    drop = norm_ppf(0.5 + level / 2) ** 2 / 2
    rest = [i for i in range(x.shape[1]) if i != j]

    def gap(v: float) -> float:
        def step(b):
            full = np.insert(b, j, v)
            ll, g, h = _logit_terms(x, y, full)
            return ll, g[rest], h[np.ix_(rest, rest)]

        ll = newton(step, len(rest), start=fit.beta[rest])[2] if rest else step(np.empty(0))[0]
        return fit.loglik - ll - drop

    out = []
    for sign in (-1, 1):
        s = float(fit.se[j])
        lo, hi = float(fit.beta[j]), float(fit.beta[j]) + sign * 2 * s
        for _ in range(30):
            if gap(hi) > 0:
                break
            hi += sign * 2 * s
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if gap(mid) < 0 else (lo, mid)
        out.append((lo + hi) / 2)
    return out[0], out[1]


def _cox_terms(x: np.ndarray, time: np.ndarray, event: np.ndarray, start: np.ndarray | None, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Efron's likelihood. Rows are sorted by time, later ones first."""
    p = x.shape[1]
    w = np.exp(np.clip(x @ b, -700, 700))
    ll, g, h = 0.0, np.zeros(p), np.zeros((p, p))
    wx = x * w[:, None]
    ends = np.searchsorted(-time, -np.unique(time[event == 1])[::-1], side="right")
    s0c, s1c = np.cumsum(w), np.cumsum(wx, axis=0)
    s2c = np.cumsum(wx[:, :, None] * x[:, None, :], axis=0)
    if start is not None:  # those who enter later are not at risk
        order = np.argsort(-start, kind="stable")
        e0, e1 = np.cumsum(w[order]), np.cumsum(wx[order], axis=0)
        e2 = np.cumsum((wx[:, :, None] * x[:, None, :])[order], axis=0)
    for end in ends:
        t = time[end - 1]
        first = np.searchsorted(-time, -t, side="left")
        dead = first + np.flatnonzero(event[first:end] == 1)
        s0, s1, s2 = s0c[end - 1], s1c[end - 1], s2c[end - 1]
        if start is not None and (k := int((start >= t).sum())):
            s0, s1, s2 = s0 - e0[k - 1], s1 - e1[k - 1], s2 - e2[k - 1]
        d = len(dead)
        d0, d1 = w[dead].sum(), wx[dead].sum(axis=0)
        d2 = wx[dead].T @ x[dead]
        ll += float((x[dead] @ b).sum())
        g += x[dead].sum(axis=0)
        for k in range(d):
            a = k / d
            r0, r1, r2 = s0 - a * d0, s1 - a * d1, s2 - a * d2
            ll -= math.log(r0)
            m = r1 / r0
            g -= m
            h += r2 / r0 - np.outer(m, m)
    return ll, g, h


def cox(x: np.ndarray, time: np.ndarray, event: np.ndarray, names: list[str], start: np.ndarray | None = None, cluster: np.ndarray | None = None) -> Fit:
    """start: entry times, for data in intervals (start, time]."""
    order = np.argsort(-time, kind="stable")
    x, time, event = x[order], time[order], event[order]
    start = None if start is None else start[order]
    x = x - x.mean(axis=0)
    b, cov, ll = newton(lambda v: _cox_terms(x, time, event, start, v), x.shape[1])
    if cluster is not None:
        cov = _sandwich(cov, _cox_scores(x, time, event, start, b), cluster[order])
    return Fit("cox", names, b, cov, ll, len(time), extra={"events": int(event.sum())})


def _cox_scores(x, time, event, start, b) -> np.ndarray:
    """Score residuals of every row, ties after Efron."""
    w = np.exp(x @ b)
    out = np.zeros_like(x)
    for t in np.unique(time[event == 1]):
        risk = (time >= t) if start is None else (time >= t) & (start < t)
        dead = risk & (time == t) & (event == 1)
        d = int(dead.sum())
        s0, s1 = w[risk].sum(), (x[risk] * w[risk, None]).sum(axis=0)
        d0, d1 = w[dead].sum(), (x[dead] * w[dead, None]).sum(axis=0)
        for k in range(d):
            a = k / d
            r0 = s0 - a * d0
            m = (s1 - a * d1) / r0
            share = np.where(dead, 1 - a, 1.0) * risk
            out -= (share * w / r0)[:, None] * (x - m)
            out[dead] += (x[dead] - m) / d
    return out


def _partial(df: DataFrame, cols: list[str], fun: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of fun's arrays, each partition's sum first."""

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                s = fun(np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns]))
                total = s if total is None else total + s
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["k", "v"])

    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).dropna().mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    if not rows:
        raise ValueError("no complete row")
    out = np.zeros(len(rows))
    for r in rows:
        out[r["k"]] = r["v"]
    return out


def fit_ols(df: DataFrame, y: str, xs: list[str]) -> Fit:
    """One pass: the products of all columns with one another, about their rough centre."""
    p = len(xs) + 1
    mid = df.agg(*[F.avg(F.col(c).cast("double")) for c in [*xs, y]]).first()
    shift = np.array([float(v or 0) for v in mid])

    def sums(a: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.ones(len(a)), a - shift])
        return (z.T @ z).ravel()

    m = _partial(df, [*xs, y], sums).reshape(p + 1, p + 1)
    g = np.linalg.pinv(m[:p, :p])
    b = g @ m[:p, p]
    n = int(round(m[0, 0]))
    rss = float(m[p, p] - b @ m[:p, p])
    # back from centred columns
    back = np.eye(p)
    back[0, 1:] = -shift[:-1]
    beta = back @ b
    beta[0] += shift[-1]
    cov = back @ (g * rss / (n - p)) @ back.T
    ll = -n / 2 * (math.log(2 * math.pi) + math.log(rss / n) + 1)
    return Fit("linear", ["(Intercept)", *xs], beta, cov, ll, n, n - p, {"sigma2": rss / (n - p)})


def fit_logistic(df: DataFrame, y: str, xs: list[str]) -> Fit:
    """Newton steps, each one pass over the data."""
    p = len(xs) + 1
    n = 0

    def step(b: np.ndarray):
        nonlocal n

        def sums(a: np.ndarray) -> np.ndarray:
            x = np.column_stack([np.ones(len(a)), a[:, :-1]])
            ll, g, h = _logit_terms(x, a[:, -1], b)
            return np.concatenate([[len(a), ll], g, h.ravel()])

        s = _partial(df, [*xs, y], sums)
        n = int(s[0])
        return s[1], s[2 : 2 + p], s[2 + p :].reshape(p, p)

    b, cov, ll = newton(step, p)
    return Fit("logistic", ["(Intercept)", *xs], b, cov, ll, n)


def fit_cox(df: DataFrame, time: str, event: str, xs: list[str]) -> Fit:
    """Rows are dealt into ranges of time once. A Newton step is two passes: each range's totals
    at risk, then each range's terms given the totals of later ranges."""
    from pyspark import TaskContext

    p = len(xs)
    cols = [F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate([*xs, time, event])]
    data = df.select(*cols).dropna().repartitionByRange(F.col(f"c{p}")).persist()
    try:
        mid = np.array([float(v) for v in data.agg(*[F.avg(f"c{i}") for i in range(p)]).first()])
        n = 0

        def arrays(batches):
            t = [np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) for b in batches if b.num_rows]
            return np.concatenate(t) if t else np.empty((0, p + 2))

        def emit(fun):
            def run(batches):
                a = arrays(batches)
                if len(a):
                    v = fun(TaskContext.get().partitionId(), a)
                    yield pa.RecordBatch.from_arrays([pa.array([float(a[0, p])]), pa.array([v.tolist()], pa.list_(pa.float64()))], names=["t", "v"])

            return [(r["t"], np.array(r["v"])) for r in data.mapInArrow(run, "t double, v array<double>").collect()]

        def step(b: np.ndarray):
            nonlocal n

            def totals(_, a):
                x = a[:, :p] - mid
                w = np.exp(np.clip(x @ b, -700, 700))
                return np.concatenate([[len(a), a[:, p].max(), w.sum()], (x * w[:, None]).sum(axis=0), ((x * w[:, None]).T @ x).ravel()])

            parts = sorted((v[1], v) for _, v in emit(totals))
            n = int(sum(v[0] for _, v in parts))
            tops = [t for t, _ in parts]
            later = np.array([sum((v[2:] for _, v in parts[i + 1 :]), np.zeros(1 + p + p * p)) for i in range(len(parts))])

            def terms(_, a):
                k = int(np.searchsorted(tops, a[:, p].max()))
                off = later[k]
                a = a[np.argsort(-a[:, p], kind="stable")]
                ll, g, h = _cox_terms_from(a[:, :p] - mid, a[:, p], a[:, p + 1], b, off[0], off[1 : 1 + p], off[1 + p :].reshape(p, p))
                return np.concatenate([[ll], g, h.ravel()])

            s = sum(v for _, v in emit(terms))
            return s[0], s[1 : 1 + p], s[1 + p :].reshape(p, p)

        b, cov, ll = newton(step, p)
    finally:
        data.unpersist()
    return Fit("cox", list(xs), b, cov, ll, n)


def _cox_terms_from(x, time, event, b, s0, s1, s2):
    """_cox_terms of one range of times, with the sums of all later ones."""
    p = x.shape[1]
    w = np.exp(np.clip(x @ b, -700, 700))
    ll, g, h = 0.0, np.zeros(p), np.zeros((p, p))
    at = 0
    while at < len(time):
        end = int(np.searchsorted(-time, -time[at], side="right"))
        xs, ws = x[at:end], w[at:end]
        s0, s1, s2 = s0 + ws.sum(), s1 + (xs * ws[:, None]).sum(axis=0), s2 + (xs * ws[:, None]).T @ xs
        dead = event[at:end] == 1
        d = int(dead.sum())
        if d:
            xd, wd = xs[dead], ws[dead]
            d0, d1, d2 = wd.sum(), (xd * wd[:, None]).sum(axis=0), (xd * wd[:, None]).T @ xd
            ll += float((xd @ b).sum())
            g += xd.sum(axis=0)
            for k in range(d):
                a = k / d
                r0, r1, r2 = s0 - a * d0, s1 - a * d1, s2 - a * d2
                ll -= math.log(r0)
                m = r1 / r0
                g -= m
                h += r2 / r0 - np.outer(m, m)
        at = end
    return ll, g, h


def fit_model(x: np.ndarray, names: list[str], y: np.ndarray, time: np.ndarray | None = None, time2: np.ndarray | None = None, cluster: np.ndarray | None = None) -> Fit:
    """cox with a time (or an interval from time to time2), logistic for two outcomes, else linear."""
    if time is not None:
        return cox(x, time if time2 is None else time2, y, names, None if time2 is None else time, cluster)
    full, all_names = np.column_stack([np.ones(len(x)), x]), ["(Intercept)", *names]
    if len(np.unique(y)) == 2:
        return logistic(full, (y == y.max()).astype(float), all_names, cluster)
    return ols(full, y, all_names, cluster)
