"""Survival curves, log-rank tests, concordance, time-dependent ROC."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinloom.functions.distributions import chi2_sf
from clinloom.operators import models
from clinloom.operators.scan import next_value, running_sum
from clinloom.sources.files import stored


def life_table(df: DataFrame, time: str, event: str, by: list[str] | None = None) -> DataFrame:
    """by..., time, n_risk, n_event, n_censor at every distinct time."""
    by = by or []
    t = df.where(F.col(time).isNotNull() & F.col(event).isNotNull()).groupBy(*by, F.col(time).cast("double").alias("time")).agg(F.count("*").alias("n"), F.sum(F.col(event).cast("long")).alias("n_event"))
    t = running_sum(t, by, "time", ["n"], descending=True)
    return t.select(*by, "time", F.col("cum_n").alias("n_risk"), "n_event", (F.col("n") - F.col("n_event")).alias("n_censor"))


def km_curve(df: DataFrame, time: str, event: str, by: list[str] | None = None) -> DataFrame:
    """The life table with the share surviving beyond each time and its standard error (Greenwood)."""
    by = by or []
    return _survival(life_table(df, time, event, by), by)


def _survival(t: DataFrame, by: list[str]) -> DataFrame:
    """km_curve() of a life table."""
    t = t.withColumns({"_l": F.when(F.col("n_event") < F.col("n_risk"), F.log1p(-F.col("n_event") / F.col("n_risk"))).otherwise(F.lit(0.0)), "_z": (F.col("n_event") == F.col("n_risk")).cast("int"), "_v": F.when(F.col("n_event") < F.col("n_risk"), F.col("n_event") / (F.col("n_risk") * (F.col("n_risk") - F.col("n_event")))).otherwise(F.lit(0.0))})
    t = running_sum(t, by, "time", ["_l", "_z", "_v"])
    surv = F.when(F.col("cum__z") > 0, F.lit(0.0)).otherwise(F.exp("cum__l"))
    return t.select(*by, "time", "n_risk", "n_event", "n_censor", surv.alias("surv"), (surv * F.sqrt("cum__v")).alias("std_err"))


def logrank(df: DataFrame, time: str, event: str, group: str) -> dict:
    """statistic, df, p and observed and expected events by group. The table by time is joined in Spark; sums come back."""
    d = df.where(F.col(group).isNotNull())
    groups = sorted(r[0] for r in d.select(group).distinct().collect())
    one = d.groupBy(F.col(time).cast("double").alias("time")).agg(F.count("*").alias("n"), F.sum(F.col(event).cast("long")).alias("d"), *[F.count_if(F.col(group) == g).alias(f"n{i}") for i, g in enumerate(groups)], *[F.sum(F.when(F.col(group) == g, F.col(event).cast("long")).otherwise(0)).alias(f"d{i}") for i, g in enumerate(groups)])
    cols = ["n", *[f"n{i}" for i in range(len(groups))]]
    t = running_sum(one, [], "time", cols, descending=True)
    n, dd = F.col("cum_n").cast("double"), F.col("d").cast("double")
    v = F.when(n > 1, dd * (n - dd) / (n - 1)).otherwise(0.0)
    share = [F.col(f"cum_n{i}") / n for i in range(len(groups))]
    aggs = [F.sum(f"d{i}").alias(f"o{i}") for i in range(len(groups))] + [F.sum(dd * s).alias(f"e{i}") for i, s in enumerate(share)]
    aggs += [F.sum(v * ((share[i] if i == j else F.lit(0.0)) - share[i] * share[j])).alias(f"v{i}_{j}") for i in range(len(groups)) for j in range(len(groups))]
    r = t.agg(*aggs).first()
    k = len(groups)
    o, e = np.array([float(r[f"o{i}"]) for i in range(k)]), np.array([float(r[f"e{i}"]) for i in range(k)])
    cov = np.array([[float(r[f"v{i}_{j}"]) for j in range(k)] for i in range(k)])
    u = (o - e)[:-1]
    stat = float(u @ np.linalg.pinv(cov[:-1, :-1]) @ u)
    return {"groups": groups, "observed": o, "expected": e, "statistic": stat, "df": k - 1, "p": chi2_sf(stat, k - 1)}


#: Cuts of the times and of the markers in concordance(); the grid of counts has at most (4 * CUTS + 2) * (2 * CUTS + 1) cells.
CUTS = 128


def _pieces(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Places among cuts, rising with x; the odd ones hold the values equal to a cut, one value each."""
    return np.searchsorted(cuts, x, side="left") + np.searchsorted(cuts, x, side="right")


def _count_pairs(place: np.ndarray, m: np.ndarray, event: np.ndarray, n: np.ndarray) -> tuple[int, int, int]:
    """(pairs, concordant, tied) of rows that stand for n alike, from an event to those of a later place.

    Places are halved again and again: an earlier and a later one are in the two halves of one piece
    at exactly one level. There the later rows of lower marker are a running count.
    """
    order = np.argsort(m, kind="stable")
    place, m, event, n = (x[order] for x in (place, m, event, n))
    out = np.zeros(3, dtype=np.int64)
    for level in range(int(place.max()).bit_length() if len(place) else 0):
        order = np.argsort(place >> (level + 1), kind="stable")
        piece, x, half = place[order] >> (level + 1), m[order], (place[order] >> level) & 1
        first = np.r_[True, piece[1:] != piece[:-1]]
        alike = first | np.r_[True, x[1:] != x[:-1]]
        upto = np.r_[0, np.cumsum(np.where(half == 1, n[order], 0))]
        starts, ties = np.flatnonzero(first), np.flatnonzero(alike)
        group, tie = np.cumsum(first) - 1, np.cumsum(alike) - 1
        begin, low, high = upto[starts][group], upto[ties][tie], upto[np.r_[ties[1:], len(x)]][tie]
        w = np.where((half == 0) & event[order], n[order], 0)
        out += [int((w * (upto[np.r_[starts[1:], len(x)]][group] - begin)).sum()), int((w * (low - begin)).sum()), int((w * (high - low)).sum())]
    return int(out[0]), int(out[1]), int(out[2])


def concordance(df: DataFrame, time: str, event: str, marker: str, cuts: int = CUTS) -> DataFrame:
    """(pairs, concordant, tied): pairs of which the earlier time is an event (or ties with a censored one).

    Times and markers are cut at quantiles of a sketch; values equal to a cut are pieces of their own, so the others are bounded
    shares of the rows. Pairs in different pieces of both are read off a grid of counts. Pairs within a piece of
    times, or else within a piece of markers, are counted in that piece's task: a row is dealt twice, however many rows there are.
    """
    d = df.select(F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e"), F.col(marker).cast("double").alias("m")).dropna()
    d = stored(d.groupBy("t", (F.col("e") != 1).cast("long").alias("c"), "m").agg(F.count("*").alias("n")))
    probs = [i / (cuts + 1) for i in range(1, cuts + 1)]
    at = d.agg(*[F.percentile_approx(x, probs, 20 * cuts).alias(x) for x in ("t", "m")]).first()
    t_cuts, m_cuts = (np.unique(np.array(at[x] or [], dtype=float)) for x in ("t", "m"))

    def place(batches):
        for b in batches:
            t, c, m, n = (x.to_numpy() for x in b.columns)
            by_time = _pieces(t, t_cuts)
            # of one time events come before censored rows, so these are two pieces
            cols = [2 * by_time + np.where(by_time % 2 == 1, c, 0), _pieces(m, m_cuts), t, c, m, n]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["p", "q", "t", "c", "m", "n"])

    rows = d.select("t", "c", "m", "n").mapInArrow(place, "p long, q long, t double, c long, m double, n long")
    cells = rows.groupBy("p", "q").agg(F.sum(F.when(F.col("c") == 0, F.col("n")).otherwise(0)).alias("events"), F.sum("n").alias("n")).toPandas()  # bounded by the cuts
    events, every = np.zeros((4 * cuts + 4, 2 * cuts + 3), dtype=np.int64), np.zeros((4 * cuts + 4, 2 * cuts + 3), dtype=np.int64)
    events[cells["p"], cells["q"]], every[cells["p"], cells["q"]] = cells["events"], cells["n"]
    later = every[::-1].cumsum(axis=0)[::-1] - every
    lower = later.cumsum(axis=1) - later
    single = np.arange(every.shape[1]) % 2 == 1
    apart = events * (later.sum(axis=1, keepdims=True) - np.where(single, 0, later))  # pairs within a piece of markers that holds several come below
    known = [int(apart.sum()), int((events * lower).sum()), int((events * later)[:, single].sum())]

    def count(key, t):
        p, times, c, m, n = (t[x].to_numpy() for x in ("p", "t", "c", "m", "n"))
        if key[0].as_py():
            p = 2 * np.unique(times, return_inverse=True)[1] + c
        return pa.table([[x] for x in _count_pairs(p, m, c == 0, n)], names=["pairs", "concordant", "tied"])

    # a piece of one time and kind, or of one marker, has nothing more to count
    within = [rows.where("p % 4 = 0").select(F.lit(True).alias("times"), F.col("p").alias("piece"), "*"), rows.where("q % 2 = 0").select(F.lit(False).alias("times"), F.col("q").alias("piece"), "*")]
    got = within[0].unionAll(within[1]).groupBy("times", "piece").applyInArrow(count, "pairs long, concordant long, tied long")
    return got.agg(*[(F.coalesce(F.sum(c), F.lit(0)) + F.lit(k)).cast("long").alias(c) for c, k in zip(("pairs", "concordant", "tied"), known)])


def calc_cindex(df: DataFrame, time: str, event: str, marker: str) -> float:
    """The share of pairs in which the higher marker has the earlier event; below a half its complement, with a warning."""
    r = concordance(df, time, event, marker).first()
    c = (r["concordant"] + r["tied"] / 2) / r["pairs"]
    if c < 0.5:
        warnings.warn("concordance below 0.5; its complement is given", stacklevel=2)
        return 1 - c
    return c


def _roc_sums(df: DataFrame, time: str, event: str, marker: str, times: tuple[float, ...], cause: int | None, ways: tuple[bool, ...]) -> DataFrame:
    """(free, at, m, case, control): weights by time, marker and way to take rows of other causes. Rows are read twice, however many times and ways there are."""
    d = df.select(F.col(time).cast("double").alias("t"), (F.col(event) != 0).cast("int").alias("e"), (F.lit(True) if cause is None else F.col(event) == cause).alias("own"), F.col(marker).cast("double").alias("m")).dropna()
    # by time all that the curve of censoring needs
    seen = stored(d.groupBy("t").agg(F.count("*").alias("n"), F.sum(1 - F.col("e")).alias("n_event"), F.max(F.col("own") & (F.col("e") == 1)).alias("own")))
    if cause is not None and seen.where("own").isEmpty():
        raise ValueError(f"no event of cause {cause}")
    risk = running_sum(seen, [], "t", ["n"], descending=True).select(F.col("t").alias("time"), F.col("cum_n").alias("n_risk"), "n_event", (F.col("n") - F.col("n_event")).alias("n_censor"))
    g = _survival(risk, []).select("time", F.col("surv").alias("g"))
    # the curve falls, so what stands before a time is the value at the next later one, going back
    back = next_value(g.withColumn("_back", -F.col("time")), [], "_back", "g", "before").drop("_back")
    g = stored(back.withColumn("before", F.coalesce("before", F.lit(1.0))))
    least = g.agg(*[F.min(F.when(F.col("time") <= u, F.col("g"))).alias(f"g{i}") for i, u in enumerate(times)]).first()
    at = {u: 1.0 if least[i] is None else least[i] for i, u in enumerate(times)}
    d = d.join(g.select(F.col("time").alias("t"), "before"), "t")
    weight, fell = 1 / F.col("before"), F.col("e") == 1
    case = {u: F.when((F.col("t") <= u) & fell & F.col("own"), weight).otherwise(0.0) for u in times}
    control = {(free, u): F.when(F.col("t") > u, F.lit(1 / at[u] if at[u] else 0.0)).when(F.lit(not free) & fell & ~F.col("own"), weight).otherwise(0.0) for free in ways for u in times}
    # one row a marker; times and ways are columns until rows are summed up
    sums = d.groupBy("m").agg(*[F.sum(v).alias(f"case{i}") for i, v in enumerate(case.values())], *[F.sum(v).alias(f"control{i}") for i, v in enumerate(control.values())])
    entry = [F.struct(F.lit(free).alias("free"), F.lit(float(u)).alias("at"), F.col(f"case{times.index(u)}").alias("case"), F.col(f"control{i}").alias("control")) for i, (free, u) in enumerate(control)]
    return stored(sums.select("m", F.explode(F.array(*entry)).alias("x")).select("x.free", "x.at", "m", "x.case", "x.control"))


def _roc_run(long: DataFrame) -> DataFrame:
    """Weights with their totals P and N and running sums from the highest marker on."""
    total = long.groupBy(F.col("free").alias("_f"), F.col("at").alias("_a")).agg(F.sum("case").alias("P"), F.sum("control").alias("N"))
    return running_sum(long, ["free", "at"], "m", ["case", "control"], descending=True).join(total, (F.col("at") == F.col("_a")) & (F.col("free") == F.col("_f")))


def _roc_areas(run: DataFrame) -> DataFrame:
    area = run.groupBy("free", "at", "P", "N").agg(F.sum(F.col("case") * (F.col("N") - F.col("cum_control") + F.col("control") / 2)).alias("a"))
    return area.select("free", F.col("at").alias("time"), (F.col("a") / F.col("P") / F.col("N")).alias("auc"))


def time_roc(df: DataFrame, time: str, event: str, marker: str, times: tuple[float, ...] = (12, 36, 60), cause: int | None = None, free: bool = True) -> tuple[pd.DataFrame, DataFrame]:
    """AUC by time, and the curve (time, threshold, tpr, fpr): cases had the event by then, controls are beyond; censoring is weighed out.

    With a cause, event holds codes (nought: censored), and cases are those of that cause. Rows that
    had another cause by then are left out, or with free=False are controls too. A cause that no row has raises.
    """
    run = _roc_run(_roc_sums(df, time, event, marker, tuple(dict.fromkeys(times)), cause, (free,)))
    curve = run.select(F.col("at").alias("time"), F.col("m").alias("threshold"), (F.col("cum_case") / F.col("P")).alias("tpr"), (F.col("cum_control") / F.col("N")).alias("fpr"))
    return _roc_areas(run).drop("free").toPandas().sort_values("time", ignore_index=True), curve


def time_auc(df: DataFrame, time: str, event: str, marker: str, times: tuple[float, ...], cause: int, ways: tuple[bool, ...] = (True, False)) -> DataFrame:
    """(free, time, auc) of time_roc for one of several causes, both ways to take rows of other causes side by side."""
    return _roc_areas(_roc_run(_roc_sums(df, time, event, marker, tuple(dict.fromkeys(times)), cause, ways)))


def proportional_hazards(df: DataFrame, time: str, event: str, xs: list[str], transform: str = "km") -> list[dict]:
    """Test of proportional hazards: by column, and for all together (term GLOBAL), chisq, df and p.

    The score test, at the fitted model, of a further coefficient that changes with g(time):
    one minus the survival just before ("km"), the time itself ("identity") or its logarithm ("log").
    Sums at risk are running sums over the distinct times; each time's part is added up where it lies. Rows
    lacking a value take no part; without events the fit's error is raised.
    """
    if transform not in ("km", "identity", "log"):
        raise ValueError(f"unknown transform {transform}")
    p, fit = len(xs), models.fit_cox(df, time, event, xs)
    d = df.select(*[F.col(c).cast("double").alias(n) for c, n in zip([*xs, time, event], [*[f"x{i}" for i in range(p)], "t", "e"])]).dropna()
    means = d.agg(*[F.avg(f"x{i}") for i in range(p)]).first()
    d = d.withColumns({f"x{i}": F.col(f"x{i}") - F.lit(float(means[i])) for i in range(p)})
    w = F.exp(sum((F.col(f"x{i}") * F.lit(float(fit.beta[i])) for i in range(p)), F.lit(0.0)))
    parts = {"0": w} | {f"1_{i}": w * F.col(f"x{i}") for i in range(p)} | {f"2_{i}_{j}": w * F.col(f"x{i}") * F.col(f"x{j}") for i in range(p) for j in range(p)}
    sums = [F.sum(v).alias(f"s{k}") for k, v in parts.items()] + [F.sum(F.when(F.col("e") == 1, v).otherwise(0.0)).alias(f"d{k}") for k, v in parts.items()]
    fallen = [F.sum(F.when(F.col("e") == 1, F.col(f"x{i}")).otherwise(0.0)).alias(f"f{i}") for i in range(p)]
    c = d.groupBy("t").agg(F.count("*").cast("double").alias("n"), F.sum("e").alias("d"), *sums, *fallen)
    at_risk = [f"cum_s{k}" for k in parts]
    c = running_sum(c, [], "t", ["n", *[f"s{k}" for k in parts]], descending=True)
    if transform == "km":
        # all fall at the last time only, which no later time looks back on
        c = c.withColumn("l", F.when(F.col("d") < F.col("cum_n"), F.log1p(-F.col("d") / F.col("cum_n"))).otherwise(0.0))
        c = running_sum(c, [], "t", ["l"]).withColumn("g", 1 - F.exp(F.col("cum_l") - F.col("l")))
    else:
        c = c.withColumn("g", F.log("t") if transform == "log" else F.col("t"))
    c = c.where("d > 0")
    mean = c.agg((F.sum(F.col("g") * F.col("d")) / F.sum("d")).alias("g")).first()["g"]
    c = c.withColumn("g", F.col("g") - F.lit(float(mean)))
    k = len(parts)

    def terms(a: np.ndarray) -> np.ndarray:
        out = np.zeros(p + 3 * p * p)
        for g, n, s, dead, f in zip(a[:, 0], a[:, 1].astype(int), a[:, 2 : 2 + k], a[:, 2 + k : 2 + 2 * k], a[:, 2 + 2 * k :]):
            share = np.arange(n) / n
            r = s - share[:, None] * dead
            m = r[:, 1 : 1 + p] / r[:, :1]
            v = (r[:, 1 + p :] / r[:, :1]).sum(axis=0) - (m.T @ m).ravel()
            out += np.concatenate([g * (f - m.sum(axis=0)), v, g * v, g * g * v])
        return out

    got = models._partial(c, ["g", "d", *at_risk, *[f"d{x}" for x in parts], *[f"f{i}" for i in range(p)]], terms)
    u = got[:p]
    v, gv, ggv = (got[p + i * p * p : p + (i + 1) * p * p].reshape(p, p) for i in range(3))
    inside = ggv - gv @ np.linalg.solve(v, gv)  # of the further coefficients, the fitted ones being free

    def row(name: str, j: list[int]) -> dict:
        x = float(u[j] @ np.linalg.solve(inside[np.ix_(j, j)], u[j]))
        return {"term": name, "chisq": x, "df": len(j), "p": chi2_sf(x, len(j))}

    return [row(x, [i]) for i, x in enumerate(xs)] + [row("GLOBAL", list(range(p)))]
