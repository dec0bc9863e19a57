"""The test of proportional hazards against the partial likelihood written out, with the further columns differentiated by number."""

import numpy as np
import pytest

from clinloom.functions.distributions import chi2_sf
from clinloom.operators import models, survival


def _loglik(x, t, e, g, b):
    """Log partial likelihood (ties after Efron) of columns x and x * g(t)."""
    p, out = x.shape[1], 0.0
    for u in np.unique(t[e == 1]):
        eta = x @ b[:p] + g[u] * (x @ b[p:])
        dead, risk = (t == u) & (e == 1), t >= u
        w = np.exp(eta)
        out += eta[dead].sum() - sum(np.log(w[risk].sum() - k / dead.sum() * w[dead].sum()) for k in range(dead.sum()))
    return out


def _by_hand(x, t, e, transform):
    times, surv, g = np.unique(t[e == 1]), 1.0, {}
    for u in times:
        g[u] = {"km": 1 - surv, "identity": u, "log": np.log(u)}[transform]
        surv *= 1 - ((t == u) & (e == 1)).sum() / (t >= u).sum()
    mean = np.average([g[u] for u in times], weights=[((t == u) & (e == 1)).sum() for u in times])
    g = {u: v - mean for u, v in g.items()}
    p, h = x.shape[1], 1e-3
    at = np.concatenate([models.cox(x, t, e, ["a", "b"]).beta, np.zeros(p)])
    step = np.eye(2 * p) * h
    f = lambda b: _loglik(x, t, e, g, b)
    grad = np.array([(f(at + s) - f(at - s)) / (2 * h) for s in step])
    info = -np.array([[(f(at + s + r) - f(at + s - r) - f(at - s + r) + f(at - s - r)) / (4 * h * h) for r in step] for s in step])
    out = []
    for j in ([0], [1], [0, 1]):
        keep = [0, 1, *[p + k for k in j]]
        u = np.concatenate([np.zeros(p), grad[p:][j]])
        out.append(float(u @ np.linalg.solve(info[np.ix_(keep, keep)], u)))
    return out


@pytest.mark.parametrize("transform", ["km", "identity", "log"])
def test_score_test_is_that_of_the_likelihood(spark, transform):
    rng = np.random.default_rng(5)
    n = 90
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 2, n).astype(float)])
    t = np.ceil(rng.exponential(np.exp(-0.5 * x[:, 0]) * 6)).clip(1)  # ties
    e = (rng.random(n) < 0.7).astype(int)
    rows = [(float(a), float(b), float(u), int(v), "k") for (a, b), u, v in zip(x, t, e)] + [(None, 1.0, 2.0, 1, "k"), (0.5, 1.0, None, 1, "k")]
    df = spark.createDataFrame(rows, "a double, b double, t double, ev int, g string").repartition(3)
    got = survival.proportional_hazards(df, "t", "ev", ["a", "b"], transform)
    assert [r["term"] for r in got] == ["a", "b", "GLOBAL"] and [r["df"] for r in got] == [1, 1, 2]
    assert np.allclose([r["chisq"] for r in got], _by_hand(x, t, e, transform), rtol=1e-3, atol=1e-4)
    assert all(r["p"] == chi2_sf(r["chisq"], r["df"]) for r in got)


def test_a_ratio_that_changes_is_found(spark):
    rng = np.random.default_rng(9)
    n = 600
    x = rng.integers(0, 2, n).astype(float)
    # group 1 fails at one time of life, group 0 at any: hazards cross
    t = np.where(x == 1, rng.normal(5, 0.5, n).clip(0.1), rng.exponential(5, n) + 0.01)
    same = rng.exponential(5, n) + 0.01
    df = spark.createDataFrame([(float(a), float(b), float(c), 1) for a, b, c in zip(x, t, same)], "x double, t double, s double, e int")
    assert survival.proportional_hazards(df, "t", "e", ["x"])[0]["p"] < 1e-6
    assert survival.proportional_hazards(df, "s", "e", ["x"])[0]["p"] > 0.001
    with pytest.raises(ValueError):
        survival.proportional_hazards(df, "t", "e", ["x"], "rank")


@pytest.mark.parametrize("free,auc", [(True, 1.0), (False, 0.75)])
def test_time_roc_of_a_cause(spark, free, auc):
    # by time 2 the first row has the cause, the second another; without censoring nothing is weighed
    rows = spark.createDataFrame([(1.0, 1, 5.0), (2.0, 2, 5.0), (3.0, 1, 1.0)], "t double, e int, m double")
    assert survival.time_roc(rows, "t", "e", "m", (2,), cause=1, free=free)[0]["auc"][0] == pytest.approx(auc)
    with pytest.raises(ValueError):
        survival.time_roc(rows, "t", "e", "m", (2,), cause=3)


def test_time_roc_reads_its_rows_twice(spark):
    from pyspark.sql import functions as F

    rows = [(float(i % 13), (i * 7) % 3, float((i * 5) % 17)) for i in range(90)]
    read = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = spark.createDataFrame(rows, "t double, e int, m double")
    got = {(r.free, r.time): r.auc for r in survival.time_auc(df.mapInArrow(look, df.schema), "t", "e", "m", (4, 8), cause=1).collect()}
    assert read.value == 2 * len(rows)
    for free in (True, False):
        auc, curve = survival.time_roc(df, "t", "e", "m", (4, 8), cause=1, free=free)
        assert [got[free, t] for t in (4.0, 8.0)] == pytest.approx(list(auc["auc"]))
        assert curve.agg(F.max("tpr"), F.max("fpr")).first() == pytest.approx((1.0, 1.0))
