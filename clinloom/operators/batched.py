"""Many regression models fitted side by side on a DataFrame of any size.

Each pass reads the rows once and sums, in every partition and for every model, what the next step needs: means,
products of columns, or a likelihood with its gradient and information at a model's present coefficients. Only these sums, a few
numbers squared a model, leave a task. No row is copied for a model and no model's rows are gathered.

Columns of models are terms, computed from a row's columns batch by batch and shared by all models that use
them. Columns are centred and scaled by their own means, so products and steps are well behaved.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinloom.functions.distributions import norm_ppf
from clinloom.operators.models import Fit, spline_basis


@dataclass(frozen=True)
class Term:
    """A number of each row: `value` of a column, its `log`, `is` (equal to a), `ge` (at least a), `bin` (which of the intervals between inner edges, closed on the right or not; with a third number, whether it is that one), `per` (divided by a), `shift` ((value - a) / b), spline curve `rcs` (knots..., which), or the product (`times`) of two terms."""

    kind: str
    column: str = ""
    args: tuple = ()

    def of(self, cols: dict[str, np.ndarray], seen: dict) -> np.ndarray:
        if self in seen:
            return seen[self]
        x, a = cols.get(self.column), self.args
        with np.errstate(all="ignore"):
            if self.kind == "value":
                out = x
            elif self.kind == "log":
                out = np.log(x)
            elif self.kind == "is":
                out = (x == a[0]).astype(float)
            elif self.kind == "ge":
                out = (x >= a[0]).astype(float)
            elif self.kind == "bin":
                out = np.where(np.isnan(x), np.nan, np.searchsorted(a[0], x, side="left" if a[1] else "right"))
                out = out if len(a) < 3 else (out == a[2]).astype(float)
            elif self.kind == "per":
                out = x / a[0]
            elif self.kind == "shift":
                out = (x - a[0]) / a[1]
            elif self.kind == "rcs":
                out = spline_basis(x, a[0])[:, a[1]]
            else:
                out = a[0].of(cols, seen) * a[1].of(cols, seen)
        seen[self] = out
        return out

    def columns(self) -> set[str]:
        return {self.column} if self.kind != "times" else self.args[0].columns() | self.args[1].columns()


@dataclass(frozen=True)
class Model:
    """kind: linear, logistic or cox. y is the outcome or event; rows lacking a needed column, or for which `where` is nought, take no part."""

    kind: str
    y: Term
    names: tuple[str, ...]
    terms: tuple[Term, ...]
    needs: tuple[str, ...]
    where: Term | None = None
    time: str | None = None
    time2: str | None = None
    cluster: str | None = None

    def columns(self) -> set[str]:
        own = [self.y, *self.terms, *([self.where] if self.where else [])]
        return set().union(*(t.columns() for t in own)) | set(self.needs) | {c for c in (self.time, self.time2) if c}


class Batch:
    """Arrays of an Arrow batch."""

    def __init__(self, b: pa.RecordBatch, names: list[str]):
        self.cols = {c: b.column(i).to_numpy(zero_copy_only=False).astype(float) for i, c in enumerate(names)}
        self.n, self.seen = b.num_rows, {}

    def rows(self, m: Model) -> np.ndarray:
        key = (m.needs, m.where)
        if key not in self.seen:
            ok = np.ones(self.n, dtype=bool)
            for c in m.needs:
                ok &= ~np.isnan(self.cols[c])
            if m.where:
                ok &= m.where.of(self.cols, self.seen) == 1
            self.seen[key] = ok
        return self.seen[key]

    def matrix(self, terms: tuple[Term, ...], ok: np.ndarray) -> np.ndarray:
        return np.column_stack([t.of(self.cols, self.seen)[ok] for t in terms]) if terms else np.empty((int(ok.sum()), 0))


class Data:
    """The rows of a DataFrame as numbers: text columns become the places of their values in given levels; other values are missing."""

    def __init__(self, df: DataFrame, models: list[Model], levels: dict[str, list] | None = None):
        levels = levels or {}
        self.names = sorted(set().union(*(m.columns() for m in models)))
        clusters = sorted({m.cluster for m in models if m.cluster})

        def number(c: str) -> Column:
            x = F.col(f"`{c}`")
            if c in levels:
                at = F.array_position(F.array(*[F.lit(v) for v in levels[c]]), x) if levels[c] else F.lit(None)
                return F.when(at > 0, at - 1).cast("double")
            return x.cast("double")

        cols = [number(c).alias(f"c{i}") for i, c in enumerate(self.names)]
        self.clusters = clusters
        self.df = df.select(*cols, *[F.col(f"`{c}`").cast("string").alias(f"k{i}") for i, c in enumerate(clusters)]).persist()
        self.parts = self.df.rdd.getNumPartitions()

    def close(self) -> None:
        self.df.unpersist()

    def sums(self, jobs: list, fun) -> list[np.ndarray | None]:
        """For each job the sum over all rows of fun(job, batch), a vector; None where no batch gave one."""
        names, k = self.names, len(self.names)

        def run(batches):
            total: dict[int, np.ndarray] = {}
            for b in batches:
                batch = Batch(b, names)
                for i, job in enumerate(jobs):
                    v = fun(job, batch)
                    if v is not None:
                        total[i] = v if i not in total else total[i] + v
            for i, v in total.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=["m", "k", "v"])

        rows = self.df.select(*[f"c{i}" for i in range(k)]).mapInArrow(run, "m int, k int, v double")
        if self.parts * len(jobs) > 4096:  # else so few numbers that the driver may add those of the partitions
            rows = rows.groupBy("m", "k").agg(F.sum("v").alias("v"))
        rows = rows.toPandas().groupby(["m", "k"], as_index=False)["v"].sum()
        out: list[np.ndarray | None] = [None] * len(jobs)
        for m, part in rows.groupby("m"):
            out[m] = part.sort_values("k")["v"].to_numpy()
        return out


@dataclass
class Scaled:
    """A model whose columns are centred and scaled; columns without variance are left out."""

    model: Model
    n: int
    mean: np.ndarray
    sd: np.ndarray
    keep: list[int]
    y_mean: float

    def z(self, batch: Batch, ok: np.ndarray) -> np.ndarray:
        x = batch.matrix(tuple(self.model.terms[i] for i in self.keep), ok)
        z = (x - self.mean[self.keep]) / self.sd[self.keep]
        return z if self.model.kind == "cox" else np.column_stack([np.ones(len(z)), z])

    def event(self, batch: Batch, ok: np.ndarray) -> np.ndarray:
        return self.model.y.of(batch.cols, batch.seen)[ok]

    def back(self) -> np.ndarray:
        """The matrix from coefficients of scaled columns to those of the columns."""
        s = self.sd[self.keep]
        if self.model.kind == "cox":
            return np.diag(1 / s)
        t = np.diag(np.r_[1.0, 1 / s])
        t[0, 1:] = -self.mean[self.keep] / s
        return t

    def fit(self, b: np.ndarray, cov: np.ndarray, ll: float, df: float = math.inf, **extra) -> Fit:
        t = self.back()
        names = [self.model.names[i] for i in self.keep]
        return Fit(self.model.kind, names if self.model.kind == "cox" else ["(Intercept)", *names], t @ b, t @ cov @ t.T, ll, self.n, df, extra | {"scaled": self, "b": b})


def _moments(m: Model, batch: Batch) -> np.ndarray | None:
    ok = batch.rows(m)
    if not ok.any():
        return None
    x, y = batch.matrix(m.terms, ok), m.y.of(batch.cols, batch.seen)[ok]
    return np.concatenate([[len(x), y.sum()], x.sum(axis=0)])


def _spread(job, batch: Batch) -> np.ndarray | None:
    m, mean = job
    ok = batch.rows(m)
    return ((batch.matrix(m.terms, ok) - mean) ** 2).sum(axis=0) if ok.any() and m.terms else None


def _scaled(data: Data, models: list[Model]) -> list[Scaled | None]:
    first = data.sums(models, _moments)
    means = [None if v is None else v[2:] / v[0] for v in first]
    spread = data.sums([(m, mean) for m, mean in zip(models, means)], lambda job, b: None if job[1] is None else _spread(job, b))
    out: list[Scaled | None] = []
    for m, v, mean, s in zip(models, first, means, spread):
        if v is None:
            out.append(None)
            continue
        sd = np.sqrt(s / v[0]) if s is not None else np.empty(0)
        keep = [i for i in range(len(sd)) if np.isfinite(sd[i]) and sd[i] > 1e-12 * max(1.0, abs(mean[i]))]
        out.append(Scaled(m, int(round(v[0])), mean, np.where(sd > 0, sd, 1.0), keep, float(v[1] / v[0])))
    return out


# linear


def _gram(s: Scaled, batch: Batch) -> np.ndarray | None:
    ok = batch.rows(s.model)
    if not ok.any():
        return None
    a = np.column_stack([s.z(batch, ok), s.event(batch, ok) - s.y_mean])
    return (a.T @ a).ravel()


def _linear(data: Data, models: list[Scaled]) -> list[Fit]:
    out = []
    for s, v in zip(models, data.sums(models, _gram)):
        p, mid = len(s.keep) + 1, s.y_mean
        m = v.reshape(p + 1, p + 1)
        g = np.linalg.pinv(m[:p, :p], hermitian=True)
        b = g @ m[:p, p]
        rss = max(float(m[p, p] - b @ m[:p, p]), 0.0)
        df = s.n - int(np.linalg.matrix_rank(m[:p, :p], hermitian=True))
        ll = -s.n / 2 * (math.log(2 * math.pi) + math.log(rss / s.n) + 1) if rss > 0 else math.inf
        b[0] += mid
        out.append(s.fit(b, g * (rss / df if df > 0 else math.nan), ll, df, bread=g))
    return out


# logistic


def _logistic_at(job, batch: Batch) -> np.ndarray | None:
    s, b = job
    ok = batch.rows(s.model)
    if not ok.any():
        return None
    z, y = s.z(batch, ok), s.event(batch, ok)
    eta = z @ b
    p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
    return np.concatenate([[(y * eta - np.logaddexp(0, eta)).sum()], z.T @ (y - p), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])


def _split(v: np.ndarray, p: int) -> tuple[float, np.ndarray, np.ndarray]:
    return float(v[0]), v[1 : 1 + p], v[1 + p :].reshape(p, p)


def _newton(starts: list[np.ndarray], evaluate, rounds: int = 60, tol: float = 1e-10) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Maxima of several likelihoods at once: evaluate([(which, place)]) gives value, gradient and information of each.

    All models that have not converged take a step in one pass; a step that worsens a model's value is halved in the next.
    """
    at, step = list(starts), [np.zeros_like(b) for b in starts]
    state: list = [None] * len(starts)
    active = list(range(len(starts)))
    for _ in range(rounds):
        if not active:
            break
        got = evaluate([(i, at[i] + step[i]) for i in active])
        left = []
        for i, new in zip(active, got):
            old = state[i]
            if old is not None and not (np.isfinite(new[0]) and new[0] >= old[0] - 1e-9 * (1 + abs(old[0]))):
                step[i] = step[i] / 2
                if np.abs(step[i]).max(initial=0) > 1e-12:
                    left.append(i)
                continue
            at[i], state[i] = at[i] + step[i], new
            if old is not None and abs(new[0] - old[0]) < tol * (abs(new[0]) + tol):
                continue
            step[i] = np.linalg.pinv(new[2], hermitian=True) @ new[1]
            left.append(i)
        active = left
    return [(b, np.linalg.pinv(s[2], hermitian=True), s[0]) for b, s in zip(at, state)]


def _logistic(data: Data, models: list[Scaled]) -> list[Fit]:
    def evaluate(asked):
        return [_split(v, len(b)) for v, (_, b) in zip(data.sums([(models[i], b) for i, b in asked], _logistic_at), asked)]

    # from the share of events on
    share = [min(max(s.y_mean, 1e-6), 1 - 1e-6) for s in models]
    got = _newton([np.r_[math.log(y / (1 - y)), np.zeros(len(s.keep))] for s, y in zip(models, share)], evaluate)
    return [s.fit(b, cov, ll, bread=cov) for s, (b, cov, ll) in zip(models, got)]


def profile_limits(data: Data, fits: list[tuple[Fit, str]], level: float = 0.95) -> list[tuple[float, float]]:
    """Limits of coefficients of logistic models, by name, at which the likelihood, maximised over the others, falls by half the chi-square quantile.

    Each end solves: the likelihood has that value, and the gradient of the other coefficients is nought. All ends take a
    Newton step of these equations in one pass.
    """
    drop = norm_ppf(0.5 + level / 2) ** 2 / 2
    ends = []
    for fit, name in fits:
        s, j = fit.extra["scaled"], fit.names.index(name)
        cov = fit.extra["bread"]
        for sign in (-1, 1):
            # along the ridge on which the other coefficients are at their best
            ends.append([s, j, fit.extra["b"], fit.extra["b"] + sign * math.sqrt(2 * drop / cov[j, j]) * cov[:, j], fit.loglik - drop, sign])
    active = list(range(len(ends)))
    for _ in range(60):
        if not active:
            break
        got = data.sums([(ends[i][0], ends[i][3]) for i in active], _logistic_at)
        left = []
        for i, v in zip(active, got):
            s, j, best, b, target, sign = ends[i]
            ll, g, h = _split(v, len(b))
            rest = [k for k in range(len(b)) if k != j]
            jac, miss = -h.copy(), -g.copy()
            jac[j], miss[j] = g, target - ll
            step = np.linalg.lstsq(jac, miss, rcond=None)[0]
            # never back over the maximum, nor far beyond twice the present distance
            far = abs(b[j] - best[j])
            scale = min(1.0, far / max(abs(step[j]), 1e-300)) if (b[j] + step[j] - best[j]) * sign <= 0 else min(1.0, 2 * far / max(abs(step[j]), 1e-300))
            if (b[j] + step[j] * scale - best[j]) * sign <= 0:
                scale /= 2
            ends[i][3] = b + scale * step
            if abs(target - ll) > 1e-9 * (1 + abs(target)) or np.abs(g[rest]).max(initial=0) > 1e-6 * (1 + abs(target)):
                left.append(i)
        active = left
    out = []
    for k in range(0, len(ends), 2):
        s, j = ends[k][:2]
        # a limit of a scaled column's coefficient; that of the intercept would need the others' too
        scale = 1.0 if j == 0 else s.sd[s.keep[j - 1]]
        out.append((float(ends[k][3][j] / scale), float(ends[k + 1][3][j] / scale)))
    return out


# proportional hazards


def _efron(s0, s1, s2, d, d0, d1, d2, xb, xs) -> np.ndarray:
    """Log likelihood, gradient and information of distinct times of events, from the sums at risk and of those that fall, ties after Efron."""
    p = s1.shape[1]
    out = np.zeros(1 + p + p * p)
    out[0], out[1 : 1 + p] = xb.sum(), xs.sum(axis=0)
    times = np.flatnonzero(d > 0)
    upto = np.cumsum(d[times])
    lo = 0
    while lo < len(times):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + 20_000, side="right")))
        t = np.repeat(times[lo:hi], d[times[lo:hi]])
        k = np.arange(len(t)) - np.repeat(np.r_[0, np.cumsum(d[times[lo:hi]])[:-1]], d[times[lo:hi]])
        a = k / d[t]
        r0 = s0[t] - a * d0[t]
        m = (s1[t] - a[:, None] * d1[t]) / r0[:, None]
        out[0] -= np.log(r0).sum()
        out[1 : 1 + p] -= m.sum(axis=0)
        out[1 + p :] += (((s2[t] - a[:, None] * d2[t]) / r0[:, None]).sum(axis=0) - (m.T @ m).ravel())
        lo = hi
    return out


def _by_time(z, t, sign, event, b):
    """Of rows by time, latest first: distinct times, sums of each time (s0, s1, s2) and of its events (d, d0, d1, d2, xb, xs)."""
    w = np.exp(np.clip(z @ b, -700, 700))
    zz = (z[:, :, None] * z[:, None, :]).reshape(len(z), -1)
    first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    add = lambda v: np.add.reduceat(v, first, axis=0)
    we, ws = w * event, w * sign
    risk = add(ws), add(z * ws[:, None]), add(zz * ws[:, None])
    dead = add(event).astype(np.int64), add(we), add(z * we[:, None]), add(zz * we[:, None]), add((z @ b) * event), add(z * event[:, None])
    return t[first], risk, dead


def _cox(data: Data, models: list[Scaled]) -> list[Fit]:
    """Rows are dealt into ranges of time once. A step is two passes: each range's sums at risk, then each
    range's times given the sums of later ranges. Times on the border of two ranges are put together from both, so one time may fill many ranges.

    With an entry time, a row stands a second time there with the opposite sign: at any time, those at risk are those who leave then or
    later less those who enter then or later.
    """
    time, time2 = models[0].model.time, models[0].model.time2
    names, at = data.names, {c: f"c{i}" for i, c in enumerate(data.names)}
    cols = [F.col(f"c{i}") for i in range(len(names))]
    stop = F.col(at[time2 or time])
    entry = F.array(F.struct(stop.alias("t"), F.lit(1.0).alias("sign")), *([F.struct(F.col(at[time]).alias("t"), F.lit(-1.0).alias("sign"))] if time2 else []))
    rows = data.df.where(stop.isNotNull()).select(*cols, F.explode(entry).alias("e")).select(*cols, "e.*").where("t is not null")
    rows = rows.repartitionByRange(F.desc("t"), F.rand(7)).sortWithinPartitions(F.desc("t")).persist()

    def arrays(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return None
        b = pa.Table.from_batches(got).combine_chunks().to_batches()[0]
        k = len(names)
        return Batch(pa.RecordBatch.from_arrays(b.columns[:k], names=[f"c{i}" for i in range(k)]), names), b.column(k).to_numpy(zero_copy_only=False), b.column(k + 1).to_numpy(zero_copy_only=False)

    def each(asked, part):
        batch, t, sign = part
        for i, (which, b) in enumerate(asked):
            s = models[which]
            ok = batch.rows(s.model)
            if ok.any():
                yield i, b, s.z(batch, ok), t[ok], sign[ok], np.where(sign[ok] > 0, s.event(batch, ok), 0.0)

    def flat(k, risk, dead):
        return np.concatenate([[risk[0][k]], risk[1][k], risk[2][k], [dead[0][k], dead[1][k]], dead[2][k], dead[3][k], [dead[4][k]], dead[5][k]])

    out_schema = "i int, lo double, hi double, what int, t double, v array<double>"

    def emit(got):
        i, lo, hi, what, t, v = zip(*got)
        return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(lo), pa.array(hi), pa.array(what, pa.int32()), pa.array(t), pa.array([x.tolist() for x in v], pa.list_(pa.float64()))], names=["i", "lo", "hi", "what", "t", "v"])

    def evaluate(asked):
        def totals(batches):
            part = arrays(batches)
            if part is None:
                return
            lo, hi, got = float(part[1][-1]), float(part[1][0]), []
            for i, b, z, t, sign, event in each(asked, part):
                times, risk, dead = _by_time(z, t, sign, event, b)
                got.append((i, lo, hi, 0, 0.0, np.concatenate([[x] if np.ndim(x) == 0 else x for x in (r.sum(axis=0) for r in risk)])))
                got += [(i, lo, hi, 1, x, flat(k, risk, dead)) for x in {lo, hi} for k in np.flatnonzero(times == x)]
            if got:
                yield emit(got)

        seen = rows.mapInArrow(totals, out_schema).collect()
        whole = [[] for _ in asked]
        borders: list[dict] = [{} for _ in asked]
        topmost: list[dict] = [{} for _ in asked]  # of ranges that end at a time and begin before it
        for r in seen:
            v = np.array(r["v"])
            if r["what"]:
                borders[r["i"]][r["t"]] = borders[r["i"]].get(r["t"], 0) + v
                if r["lo"] < r["t"]:
                    topmost[r["i"]][r["t"]] = topmost[r["i"]].get(r["t"], 0) + v
            else:
                whole[r["i"]].append((r["lo"], r["hi"], v))
        spans = sorted({(r["lo"], r["hi"]) for r in seen})
        # at risk after a range's inner times: all ranges that begin at or beyond its end, and border rows there that others hold
        later, out = {}, []
        for i, (_, b) in enumerate(asked):
            p = len(b)
            size = 1 + p + p * p
            lows = np.array([w[0] for w in whole[i]])
            order = np.argsort(-lows)
            lows, run = lows[order], np.cumsum(np.array([whole[i][k][2] for k in order]), axis=0) if len(order) else np.empty((0, size))
            def beyond(x):
                """Sums of ranges that lie at or after a time as a whole, ranges of that time alone among them."""
                k = int(np.searchsorted(-lows, -x, side="right"))
                return run[k - 1] if k else np.zeros(size)

            for lo, hi in spans:
                later[i, lo, hi] = beyond(hi)
            # a range that ends at a time but begins before it gives only its rows of that time
            for x, v in borders[i].items():
                risk = beyond(x) + (topmost[i][x][:size] if x in topmost[i] else 0)
                d = v[size:]
                args = (risk[None, 0], risk[None, 1 : 1 + p], risk[None, 1 + p :], np.array([round(d[0])], dtype=np.int64), d[None, 1], d[None, 2 : 2 + p], d[None, 2 + p : 2 + p + p * p], d[None, 2 + p + p * p], d[None, 3 + p + p * p :])
                borders[i][x] = _efron(*args)
            out.append(sum(borders[i].values(), np.zeros(size)))

        def inner(batches):
            part = arrays(batches)
            if part is None:
                return
            lo, hi, got = float(part[1][-1]), float(part[1][0]), []
            for i, b, z, t, sign, event in each(asked, part):
                p = len(b)
                times, risk, dead = _by_time(z, t, sign, event, b)
                off = later[i, lo, hi]
                s0, s1, s2 = np.cumsum(risk[0]) + off[0], np.cumsum(risk[1], axis=0) + off[1 : 1 + p], np.cumsum(risk[2], axis=0) + off[1 + p :]
                use = (times > lo) & (times < hi)
                if use.any():
                    got.append((i, lo, hi, 2, 0.0, _efron(s0[use], s1[use], s2[use], *[x[use] for x in dead])))
            if got:
                yield emit(got)

        for r in rows.mapInArrow(inner, out_schema).select("i", F.posexplode("v").alias("k", "v")).groupBy("i", "k").agg(F.sum("v").alias("v")).collect():
            out[r["i"]][r["k"]] += r["v"]
        return [_split(v, len(b)) for v, (_, b) in zip(out, asked)]

    try:
        got = _newton([np.zeros(len(s.keep)) for s in models], evaluate)
    finally:
        rows.unpersist()
    return [s.fit(b, cov, ll, bread=cov) for s, (b, cov, ll) in zip(models, got)]


def _sandwich(data: Data, fits: list[Fit]) -> None:
    """Replaces covariances by those from the scores summed by cluster (linear and logistic models)."""
    names, at = data.names, {c: len(data.names) + i for i, c in enumerate(data.clusters)}
    size = max(len(f.beta) for f in fits)
    schema = ", ".join(["m int", "g string", *(f"v{i} double" for i in range(size))])

    def run(batches):
        for b in batches:
            batch = Batch(pa.RecordBatch.from_arrays(b.columns[: len(names)], names=names), names)
            for i, f in enumerate(fits):
                s = f.extra["scaled"]
                groups = b.column(at[s.model.cluster])
                ok = batch.rows(s.model) & groups.is_valid().to_numpy(zero_copy_only=False)
                if not ok.any():
                    continue
                z, y = s.z(batch, ok), s.event(batch, ok)
                eta = z @ f.extra["b"]
                score = z * (y - (eta if f.kind == "linear" else 1 / (1 + np.exp(-np.clip(eta, -700, 700)))))[:, None]
                code, place = np.unique(np.array(groups.filter(pa.array(ok)).to_pylist(), dtype=object), return_inverse=True)
                total = np.zeros((len(code), size))
                np.add.at(total, (place[:, None], np.arange(z.shape[1])), score)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), i, np.int32)), pa.array(code, pa.string()), *[pa.array(total[:, k]) for k in range(size)]], names=["m", "g", *[f"v{k}" for k in range(size)]])

    by = data.df.mapInArrow(run, schema).groupBy("m", "g").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(size)])
    for r in by.groupBy("m").agg(*[F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"s{i}_{j}") for i in range(size) for j in range(size)]).collect():
        f = fits[r["m"]]
        p, s = len(f.beta), f.extra["scaled"]
        meat = np.array([[r[f"s{i}_{j}"] for j in range(p)] for i in range(p)])
        t, bread = s.back(), f.extra["bread"]
        f.cov = t @ bread @ meat @ bread @ t.T


def tally(df: DataFrame, models: list[Model], levels: dict[str, list] | None = None) -> list[tuple[int, float]]:
    """Of models, whatever their terms: rows that take part, and the sum of their outcomes."""
    data = Data(df, models, levels)
    try:
        got = data.sums([replace(m, terms=()) for m in models], _moments)
    finally:
        data.close()
    return [(0, 0.0) if v is None else (int(round(v[0])), float(v[1])) for v in got]


def histogram(df: DataFrame, column: str, edges: np.ndarray) -> np.ndarray:
    """Rows in each interval between edges, the last closed on the right too."""
    data = Data(df, [Model("linear", Term("value", column), (), (), ())])
    try:
        got = data.sums([0], lambda _, b: np.histogram(x[~np.isnan(x)], edges)[0].astype(float) if len(x := b.cols[column]) else None)[0]
    finally:
        data.close()
    return np.zeros(len(edges) - 1, dtype=np.int64) if got is None else np.rint(got).astype(np.int64)


def fit_many(df: DataFrame, models: list[Model], levels: dict[str, list] | None = None, least: int = 1, limits: dict[int, list[str]] | None = None) -> list[Fit | None]:
    """The fits of all models in the passes of one. None where fewer than `least` rows are complete or no column varies.

    limits: of logistic models, by place, the coefficients whose profile limits go to fit.extra["limits"].
    """
    if not models:
        return []
    if any(m.kind == "cox" and m.cluster for m in models):
        raise NotImplementedError("clusters of proportional-hazards models are fitted from arrays only")
    data = Data(df, models, levels)
    try:
        scaled = _scaled(data, models)
        out: list[Fit | None] = [None] * len(models)
        for kind, fitter in (("linear", _linear), ("logistic", _logistic), ("cox", _cox)):
            groups: dict[tuple, list[int]] = {}
            for i, s in enumerate(scaled):
                if s and s.model.kind == kind and s.n >= least and (s.keep or kind != "cox"):
                    groups.setdefault((s.model.time, s.model.time2), []).append(i)
            for members in groups.values():
                for i, f in zip(members, fitter(data, [scaled[i] for i in members])):
                    out[i] = f
        if clustered := [f for f in out if f and f.extra["scaled"].model.cluster]:
            _sandwich(data, clustered)
        wanted = [(i, c) for i, names in (limits or {}).items() if out[i] for c in names if c in out[i].names]
        for (i, c), v in zip(wanted, profile_limits(data, [(out[i], c) for i, c in wanted]) if wanted else []):
            out[i].extra.setdefault("limits", {})[c] = v
        return out
    finally:
        data.close()
