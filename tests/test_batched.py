"""Models fitted side by side on Spark equal those fitted from arrays; exact quantiles equal numpy's."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clinloom.operators import batched as B
from clinloom.operators import models as M
from clinloom.operators import regression as R
from clinloom.operators.quantiles import quantiles
from clinloom.operators.regression_frames import few_values

N = 500


@pytest.fixture(scope="module")
def people():
    rng = np.random.default_rng(1)
    p = pd.DataFrame({"age": rng.normal(60, 9, N), "bmi": rng.normal(25, 3, N), "sex": rng.choice(["F", "M"], N), "site": rng.integers(1, 4, N), "ward": rng.choice(["u", "v", "w"], N)})
    p["dead"] = (rng.random(N) < 1 / (1 + np.exp(-(p["age"] - 60) / 9))).astype(int)
    p["time"] = rng.exponential(10, N).round(0) + 1
    p["start"] = np.maximum(p["time"] - rng.integers(1, 20, N), 0.0)
    p["lin"] = p["age"] * 0.3 + rng.normal(size=N)
    p.loc[p.index % 11 == 0, "bmi"] = np.nan
    return p


@pytest.fixture(scope="module")
def frame(spark, people):
    return spark.createDataFrame(people).withColumn("bmi", F.when(F.isnan("bmi"), None).otherwise(F.col("bmi"))).repartition(4).persist()


def value(c):
    return B.Term("value", c)


MALE = B.Term("is", "sex", (1.0,))


def model(kind, y, terms, needs, **more):
    return B.Model(kind, value(y), tuple(map(str, range(len(terms)))), tuple(terms), (y, *needs), **more)


def test_fits_side_by_side_equal_arrays(people, frame):
    p, q, one = people, people.dropna(), np.ones(N)
    male, both = (p["sex"] == "M").to_numpy(float), ["age", "sex"]
    models = [
        model("linear", "lin", [value("age"), MALE], both),
        model("logistic", "dead", [value("age"), value("bmi"), MALE], [*both, "bmi"]),
        model("cox", "dead", [value("age"), MALE], [*both, "time"], time="time"),
        model("cox", "dead", [value("bmi")], ["bmi", "time"], time="time"),
        model("cox", "dead", [value("age"), MALE], [*both, "time", "start"], time="start", time2="time"),
        model("linear", "lin", [value("age"), MALE], both, cluster="ward"),
        model("logistic", "dead", [value("age"), MALE], both, cluster="ward"),
        model("logistic", "dead", [value("age")], both, where=MALE),
        model("linear", "lin", [value("age"), B.Term("is", "sex", (7.0,))], both),
        model("linear", "lin", [value("age")], ["age"], where=B.Term("is", "sex", (9.0,))),
    ]
    got = B.fit_many(frame, models, {"sex": ["F", "M"]}, limits={1: ["0", "1"]})
    x, dead, time = np.column_stack([p["age"], male]), p["dead"].to_numpy(float), p["time"].to_numpy()
    full = np.column_stack([one, x])
    some = np.column_stack([np.ones(len(q)), q["age"], q["bmi"], q["sex"] == "M"]).astype(float)
    want = [
        M.ols(full, p["lin"].to_numpy(), list("iab")),
        M.logistic(some, q["dead"].to_numpy(float), list("iabc")),
        M.cox(x, time, dead, list("ab")),
        M.cox(q[["bmi"]].to_numpy(), q["time"].to_numpy(), q["dead"].to_numpy(float), ["b"]),
        M.cox(x, time, dead, list("ab"), start=p["start"].to_numpy()),
        M.ols(full, p["lin"].to_numpy(), list("iab"), p["ward"].to_numpy()),
        M.logistic(full, dead, list("iab"), p["ward"].to_numpy()),
        M.logistic(full[male == 1][:, :2], dead[male == 1], list("ia")),
        M.ols(full[:, :2], p["lin"].to_numpy(), list("ia")),
    ]
    for i, (a, b) in enumerate(zip(got, want)):
        assert np.allclose(a.beta, b.beta, rtol=1e-5, atol=1e-8), i
        assert np.allclose(a.cov, b.cov, rtol=1e-4, atol=1e-10) and a.loglik == pytest.approx(b.loglik) and (a.n, a.df_resid) == (b.n, b.df_resid), i
    assert got[9] is None and got[8].names == ["(Intercept)", "0"]  # no row; a column that does not vary
    for name, j in (("0", 1), ("1", 2)):
        assert got[1].extra["limits"][name] == pytest.approx(M.profile_limits(some, q["dead"].to_numpy(float), want[1], j), rel=1e-5)
    # the score is nought at the coefficients
    eta = some @ got[1].beta
    assert np.allclose(some.T @ (q["dead"].to_numpy() - 1 / (1 + np.exp(-eta))), 0, atol=1e-4)


def test_hazards_with_one_time_in_many_ranges(spark):
    rng = np.random.default_rng(3)
    t = np.where(rng.random(400) < 0.6, 5.0, rng.integers(1, 10, 400).astype(float))
    x, e = rng.normal(size=400), (rng.random(400) < 0.5).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"t": t, "x": x, "e": e})).repartition(3)
    (got,) = B.fit_many(df, [B.Model("cox", value("e"), ("x",), (value("x"),), ("e", "t", "x"), time="t")])
    want = M.cox(x[:, None], t, e, ["x"])
    assert got.beta == pytest.approx(want.beta) and got.cov == pytest.approx(want.cov) and got.loglik == pytest.approx(want.loglik)


def alike(a, b):
    a, b = pd.DataFrame(a), pd.DataFrame(b)
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in a.columns:
        for x, y in zip(a[c], b[c]):
            if pd.isna(x) or pd.isna(y):
                assert pd.isna(x) and pd.isna(y), c
            elif isinstance(x, (int, float, np.number)):
                assert float(x) == pytest.approx(float(y), rel=1e-5, abs=1e-9), c
            else:
                assert str(x) == str(y), c


SPECS = [R.ModelSpec("dead"), R.ModelSpec("lin", covars=("sex",)), R.ModelSpec("dead", time="time", covars=("ward",))]


@pytest.mark.parametrize("spec", SPECS, ids=["logistic", "linear", "cox"])
def test_tables_of_spark_equal_tables_of_pandas(people, frame, spec):
    for predictor, knots, form in (("age", 0, "full"), ("site", 0, "predictor_combined"), ("age", 4, "full"), ("bmi", 0, "predictor_split")):
        alike(R.regression_fit(frame, spec, predictor, knots, form), R.regression_fit(people, spec, predictor, knots, form))
    alike(R.regression_forest(frame, spec, {"a": ["age"], "b": ["bmi", "site"]}), R.regression_forest(people, spec, {"a": ["age"], "b": ["bmi", "site"]}))
    alike(R.subgroup_forest(frame, spec, "age", ["sex", "site", "bmi"], standardize_x=True), R.subgroup_forest(people, spec, "age", ["sex", "site", "bmi"], standardize_x=True))
    alike(R.regression_basic_results(frame, spec, "age", {"Adj": ["bmi"]}, factor_breaks=[50, 60]), R.regression_basic_results(people, spec, "age", {"Adj": ["bmi"]}, factor_breaks=[50, 60]))
    alike(R.interaction_plot(frame, spec, "age", "site"), R.interaction_plot(people, spec, "age", "site"))
    a, b = R.predictor_effect_plot(frame, spec, "age", knot=None), R.predictor_effect_plot(people, spec, "age", knot=None)
    alike(a["curve"], b["curve"])
    alike(a["histogram"], b["histogram"])
    assert a["details"]["aic"] == pytest.approx(b["details"]["aic"]) and a["details"]["reference"] == pytest.approx(b["details"]["reference"])


@pytest.mark.parametrize("spec", SPECS, ids=["logistic", "linear", "cox"])
def test_scans_equal_models_one_by_one(people, frame, spec):
    names = ["age", "bmi", "site", "sex"]
    scan = R.regression_scan(frame, spec, names).set_index("predictor")
    for p in names:
        own = R.replace(spec, covars=tuple(c for c in spec.covars if c != p))
        (row,) = R.regression_fit(people, own, p, 0, "predictor_combined", profile=False)
        assert scan.loc[p, "original.p"] == pytest.approx(row["p_value"], rel=1e-5, abs=1e-12)
        assert scan.loc[p, "nvalid"] == people[p].notna().sum()
        if p in ("age", "bmi"):
            assert scan.loc[p, "original.effect"] == pytest.approx(row["estimate"], rel=1e-5)
            (row,) = R.regression_fit(people, own, p, 4, "predictor_combined")
            assert [scan.loc[p, "rcs.overall.p"], scan.loc[p, "rcs.nonlinear.p"]] == pytest.approx([row["p_value"], row["nonlinear_p"]], rel=1e-4, abs=1e-12)
            high = people.assign(**{p: pd.Categorical(np.where(people[p].isna(), None, np.where(people[p] < people[p].median(), "Low", "High")), ["Low", "High"])})
            (row,) = R.regression_fit(high, own, p, 0, "predictor_combined", profile=False)
            assert [scan.loc[p, "categorized.effect"], scan.loc[p, "categorized.p"]] == pytest.approx([row["estimate"], row["p_value"]], rel=1e-5)
    pairs = R.interaction_scan(frame, spec, ["age", "bmi"], ["sex", "bmi"]).set_index(["predictor", "group.by"])
    assert len(pairs) == 3
    for (p, g), r in pairs.iterrows():
        assert r["linear.p"] == pytest.approx(R.interaction_p_value(people, spec, p, g), rel=1e-4)
        assert r["rcs.p"] == pytest.approx(R.interaction_p_value(people, spec, p, g, 4), rel=1e-4)
        assert r["nvalid"] == people[[p, g]].dropna().shape[0]


def test_few_values(spark):
    d = spark.createDataFrame([(float(i % 4), f"t{i % 9}", i % 2 == 0 if i else None) for i in range(100)], "a double, b string, c boolean").repartition(7)
    assert few_values(d, ["a", "b", "c"], 8) == {"a": [0.0, 1.0, 2.0, 3.0], "b": None, "c": [0.0, 1.0]}
    assert few_values(d.limit(0), ["a"]) == {"a": []}


@pytest.mark.parametrize(("gather", "accuracy", "grid", "plain"), [(8192, 2000, 128, 0), (100, 200, 32, 0), (8192, 2000, 128, 100_000)], ids=["one bracket", "narrowed", "plain"])
def test_quantiles_equal_numpy(spark, monkeypatch, gather, accuracy, grid, plain):
    monkeypatch.setattr("clinloom.operators.quantiles.ACCURACY", accuracy)
    monkeypatch.setattr("clinloom.operators.quantiles.GRID", grid)
    rng = np.random.default_rng(0)
    n, probs = 20_000, [0, 0.025, 0.5, 0.9, 1]
    p = pd.DataFrame({"g": rng.choice(["a", "b", None], n, p=[0.9, 0.08, 0.02]), "x": rng.lognormal(0, 3, n), "y": rng.integers(0, 5, n).astype(float)})
    p.loc[0, "x"], p.loc[p.index % 7 == 0, "y"] = 1e300, np.nan  # one far value; ties and missing ones
    d = spark.createDataFrame(p).unionAll(spark.createDataFrame([("empty", None, None)], "g string, x double, y double")).repartition(5)
    for by in ([], ["g"]):
        for r in quantiles(d, {"x": F.col("x"), "y": F.col("y")}, probs, by, gather, plain).collect():
            part = p if not by else p[p["g"].isna()] if r["g"] is None else p[p["g"] == r["g"]]
            for c in "xy":
                v = part[c].dropna().to_numpy()
                assert r[f"n_{c}"] == len(v)
                assert r[f"q_{c}"] == ([None] * 5 if not len(v) else pytest.approx(np.quantile(v, probs).tolist(), rel=1e-12))
    none = quantiles(d.limit(0), {"x": F.col("x")}, [0.5], plain=plain - 1).first()
    assert none["n_x"] == 0 and none["q_x"] == [None]
    assert quantiles(d, {"x": F.col("x")}, [0.5], ["g"], gather, plain).where("g = 'empty'").first()["q_x"] == [None]
