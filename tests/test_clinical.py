import math
import random
import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clinloom.functions.distributions import adjust, chi2_sf, f_sf, norm_ppf, t_ppf, t_sf2, tukey_sf
from clinloom.operators import baseline, classification, cut, encoding, models, normality, outliers, overview, quality, regression, screening, subset, survival, units, views
from clinloom.sources import files


def test_waterfall(spark):
    d = spark.createDataFrame([(1, 15.0, "F", 1.0, False), (2, 40.0, "F", None, False), (3, 41.0, "M", 3.0, None), (4, 50.0, "M", 2.0, True), (5, 60.0, "F", 2.0, False), (6, 70.0, "F", 2.0, False)], "id int, age double, sex string, v double, dementia boolean")
    got = {r.Criteria: r.N for r in quality.exclusion_count(d, {"young": "age < 18", "no value": F.col("v").isNull(), "dementia": "dementia"}).collect()}
    assert got == {"Initial N": 6, "young": 1, "no value": 1, "dementia": 2, "Final N": 2}
    keep = {r.Criteria: r.N for r in quality.exclusion_count(d, {"dementia": "dementia"}, na_exclude=False).collect()}
    assert keep["dementia"] == 1
    with pytest.raises(ValueError):
        quality.exclusion_count(d, {})


def test_nonnumeric(spark):
    d = spark.createDataFrame(list(enumerate(["12.3", "45..6", "78a9", None, "１２", "987", "45..6"], 1)), "i int, x string")
    assert [r.value for r in quality.check_nonnum(d, "x", "i", max_count=9).collect()] == ["45..6", "78a9", "１２"]
    assert [r.idx for r in quality.check_nonnum(d, "x", "i", return_idx=True).collect()] == [2, 3, 5, 7]
    wide = quality.df_view_nonnum(d.withColumn("y", F.lit("1")), order_by="i").orderBy("row").collect()
    assert [r.x for r in wide] == ["45..6", "78a9", "１２"] and "y" not in wide[0].asDict()


def test_outliers(spark):
    d = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5, 100)] + [(None,)], "x double")

    def flags(method, k=None):
        return {r.x: r.outlier for r in outliers.flag_outliers(d, "x", method, k).collect()}

    assert [x for x, f in flags("iqr").items() if f] == [x for x, f in flags("mad").items() if f] == [100.0]
    assert not any(flags("zscore").values()) and flags("zscore", 2)[100.0] and flags("iqr")[None] is None
    r = outliers.detect_outliers(d, "x").first()
    assert (r.outlier_count, r.outlier_pct, r.max_after, r.var_after) == (1, 16.67, 5.0, 2.5)
    assert not any(x.outlier for x in outliers.flag_outliers(d.where("x = 1"), "x", "zscore").collect())
    with pytest.raises(ValueError):
        outliers.flag_outliers(d, "x", "none")


def test_units(spark):
    d = spark.createDataFrame([(i, s, float(v), u) for i, (s, v, u) in enumerate([("a", 1, "mg"), ("a", 2, None), ("b", 3, "dL"), ("b", 4, "dL"), ("b", 5, "L"), ("c", 6, "mm"), ("c", 7, "cm"), ("d", 8, "x")])], "i int, s string, v double, u string")
    rules = [units.UnitRule("a", "mg", {None: 10.0}), units.UnitRule("b", None, {"L": 2.0}), *units.rules_from_table([("c", "cm", "t"), ("c", "mm", 0.1), ("c", "zz", None)]), units.UnitRule("d", None, {"x": 5.0})]
    got = [(r.v, r.u) for r in units.unit_standardize(d, "s", "v", "u", rules, order_by="i").orderBy("i").collect()]
    assert [x for x, _ in got] == pytest.approx([1, 20, 3, 4, 10, 0.6, 7, 8]) and [u for _, u in got] == ["mg", "mg", "dL", "dL", "dL", "cm", "cm", "x"]
    gone = units.unit_standardize(d, "s", "v", "u", [units.UnitRule("c", "cm", {}, ("mm",))])
    assert [r.v for r in gone.where("s = 'c'").orderBy("i").collect()] == [None, 7]
    for bad in (lambda: units.UnitRule("", "x"), lambda: units.UnitRule("a", "x", {"x": 1.0}), lambda: units.rules_from_table([("a", "x", "t"), ("a", "y", "t")])):
        with pytest.raises(ValueError):
            bad()


def test_views(spark):
    d = spark.createDataFrame([("a", 1.0, "x"), ("a", 2.0, "y"), ("b", 3.0, "x")], "s string, v double, u string")
    assert sorted(r.unit for r in views.unit_view(d, "s", "v", "u").collect()) == ["x", "y"]
    assert views.unit_view(d, "s", "v", "u", conflicts_only=False).count() == 3
    assert views.subject_view(d, "s", ["u"], "v").columns == ["subject", "target_subject", "count", "nvalid", "mean", "sd", "median", "u"]
    long = spark.createDataFrame([(1, "A", 3.0, 0), (1, "A", 5.0, 1), (1, "B", 2.0, 2), (2, "A", 1.0, 3)], "id int, item string, v double, o int")
    assert [tuple(r) for r in views.to_wide(long, ["id"], "item", "v", ["A", "B", "C"], agg=F.max).orderBy("id").collect()] == [(1, 5, 2, None), (2, 1, None, None)]
    assert views.to_wide(long, ["id"], "item", "v", order_by="o").columns == ["id", "A", "B"]


def test_cut(spark):
    d = spark.createDataFrame([(float(v),) for v in [1] * 10 + [2] * 90], "x double")
    with pytest.warns(UserWarning):
        got = cut.cut_by(d, "x", [1 / 3, 2 / 3], "c", breaks_as_quantiles=True)
    assert got.groupBy("c").count().where("count = 90").count() == 1
    n = spark.createDataFrame([(float(v),) for v in range(11)], "x double")
    c = cut.cut_by(n, "x", [5], "c", label_type="LMH")
    assert {r.x: r.c for r in c.collect()}[5.0] == "High"
    assert cut.interval_names([-2.31, -0.223, 2.4]) == ["[-2.31,-0.223)", "[-0.223,2.4]"]
    for bad in (lambda: cut.cut_by(n, "x", [50], "c"), lambda: cut.cut_by(n, "x", [2, 4, 6], "c", label_type="LMH")):
        with pytest.raises(ValueError):
            bad()
    flat = spark.createDataFrame([("g", 1.0), ("g", 1.0)], "g string, x double")
    assert {r.c for r in cut.cut_by(flat, "x", [0.5], "c", True, group="g").collect()} == {"Low"}


@pytest.mark.parametrize("adaptive", [False, True])
def test_subset_keeps_its_bounds(spark, adaptive):
    rng = random.Random(3)
    d = spark.createDataFrame([(i, *[None if rng.random() < p else 1.0 for p in (0.05, 0.1, 0.2, 0.5, 0.9)]) for i in range(60)], "i int, a double, b double, c double, d double, e double")
    got = subset.get_valid_subset(d, "i", row_na_ratio=0.3, col_na_ratio=0.2, adaptive_scoring=adaptive)
    r = quality.max_missing_rates(got, [c for c in got.columns if c != "i"]).first()
    assert r.row <= 0.3 + 1e-9 and r.col <= 0.2 + 1e-9 and got.count() > 20 and len(got.columns) > 2


def _plain_subset(pattern, count, row_max, col_max, priority):
    """One row or column a step, on lists of rows."""
    left, cols = list(count), set(range(len(pattern[0])))

    def row_rate(i, use):
        return sum(pattern[i][j] for j in use) / len(use) if use else 0.0

    def col_rate(j, left):
        return sum(p[j] * k for p, k in zip(pattern, left)) / sum(left) if sum(left) else 0.0

    def fits(left, use):
        return all(row_rate(i, use) <= row_max + 1e-12 for i, k in enumerate(left) if k) and all(col_rate(j, left) <= col_max + 1e-12 for j in use)

    while sum(left) and cols:
        steps = [(-(row_rate(i, cols) - row_max) / priority, 0, i) for i, k in enumerate(left) if k and row_rate(i, cols) - row_max > 1e-12]
        steps += [(-(col_rate(j, left) - col_max), 1, j) for j in cols if col_rate(j, left) - col_max > 1e-12]
        if not steps:
            break
        _, kind, i = min(steps)
        if kind:
            cols.remove(i)
        else:
            left[i] -= 1
    while True:
        steps = [(-(row_rate(i, cols) - row_max) / priority, 0, i) for i, k in enumerate(left) if k < count[i] and row_rate(i, cols) <= row_max + 1e-12]
        back = {j: col_rate(j, left) if sum(left) else 1.0 for j in set(range(len(pattern[0]))) - cols}
        steps += [(-(r - col_max), 1, j) for j, r in back.items() if r <= col_max + 1e-12]
        for _, kind, i in sorted(steps):
            new_left, new_cols = [k + (kind == 0 and h == i) for h, k in enumerate(left)], cols | ({i} if kind else set())
            if fits(new_left, new_cols):
                left, cols = new_left, new_cols
                break
        else:
            return left, cols


def test_subset_in_runs_is_the_plain_loop():
    rng = np.random.default_rng(4)
    for _ in range(150):
        c = int(rng.integers(1, 6))
        pattern = [[int(b) for b in f"{i:0{c}b}"] for i in rng.choice(2**c, int(rng.integers(1, 2**c + 1)), replace=False)]
        count = rng.integers(1, 10, len(pattern))
        row_max, col_max = rng.choice([0, 0.1, 0.25, 0.3, 0.5, 0.8], 2)
        priority = float(rng.choice([0.5, 1, 2]))
        left, cols = subset.greedy(np.array(pattern, dtype=bool), count, np.arange(len(pattern)), row_max, col_max, priority)
        want = _plain_subset(pattern, count.tolist(), row_max, col_max, priority)
        assert (left.tolist(), set(np.flatnonzero(cols).tolist())) == want


def test_overview(spark):
    d = spark.createDataFrame([(i, float(i % 9) if i else 900.0, ["x", "X", "y"][i % 3], "5", None, i % 2 == 0) for i in range(30)], "id int, v double, s string, n string, empty string, b boolean")
    o = overview.data_overview(d)
    found = {(r.issue, r.variable) for r in o.issues.collect()}
    assert {("case_issues", "s"), ("numeric_as_character", "n"), ("empty_columns", "empty"), ("outliers", "v"), ("near_zero_variance", "n")} <= found
    assert o.numeric.count() == 2 and o.logical.count() == 1 and o.recommendations.count() >= 5


def test_encoding(spark):
    d = spark.createDataFrame([(0, bytearray("你好".encode("gbk"))), (1, bytearray(b"plain")), (2, None)], "i int, x binary")
    with pytest.warns(UserWarning):
        got = encoding.auto_encoding_repair(d, "x")
    assert [r.x for r in got.orderBy("i").collect()] == ["你好", "plain", None]
    bad = spark.createDataFrame([(0, bytearray(b"\xff\xfe\x81")), (1, bytearray(b"ok"))], "i int, x binary")
    with pytest.warns(UserWarning):
        assert [r.x for r in encoding.auto_encoding_repair(bad, "x", "utf-8").orderBy("i").collect()] == [None, "ok"]


def test_files(spark, tmp_path):
    for n, rows in (("one.csv", ["1,a", "2,b", "2,b"]), ("two.csv", ["2,b", "3,c"]), ("three.txt", ["9,z"])):
        (tmp_path / n).write_text("\n".join(["a,origin_file", *rows]) + "\n")
    assert files.combine_files(spark, str(tmp_path), r"\.csv$").count() == 3
    named = files.combine_files(spark, str(tmp_path), r"\.csv$", add_file_name=True)
    assert named.columns[0] == "origin_file_" and named.count() == 4
    assert files.combine_files(spark, str(tmp_path), "none") is None


def test_distributions():
    assert chi2_sf(3.841459, 1) == pytest.approx(0.05, rel=1e-5)
    assert t_sf2(2.228139, 10) == pytest.approx(0.05, rel=1e-5) and t_ppf(0.975, 10) == pytest.approx(2.228139, rel=1e-6)
    assert f_sf(4.964603, 1, 10) == pytest.approx(0.05, rel=1e-5) and norm_ppf(0.975) == pytest.approx(1.959964, rel=1e-6)
    assert tukey_sf(3.877676, 3, 10) == pytest.approx(0.05, abs=2e-4)
    assert adjust([0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.04, 0.04])


def test_models_agree_on_any_size(spark):
    rng = np.random.default_rng(0)
    n = 300
    x = rng.normal(size=(n, 2))
    y = 1 + 2 * x[:, 0] + rng.normal(size=n)
    yb = (rng.random(n) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    t, e = np.ceil(rng.exponential(np.exp(-x[:, 0] / 2)) * 20), (rng.random(n) < 0.7).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y, "yb": yb, "t": t, "e": e})).repartition(3)
    one = np.column_stack([np.ones(n), x])
    names = ["i", "a", "b"]
    for u, v in ((models.ols(one, y, names), models.fit_ols(df, "y", ["a", "b"])), (models.logistic(one, yb, names), models.fit_logistic(df, "yb", ["a", "b"])), (models.cox(x, t, e, names[1:]), models.fit_cox(df, "t", "e", ["a", "b"]))):
        assert u.beta == pytest.approx(v.beta) and u.se == pytest.approx(v.se) and u.loglik == pytest.approx(v.loglik)
    # a hand-solved case: two subjects with an event each, then one without
    c = models.cox(np.array([[1.0], [0.0], [1.0]]), np.array([1.0, 2.0, 3.0]), np.array([1.0, 1.0, 0.0]), ["x"])
    b = c.beta[0]
    assert c.loglik == pytest.approx(b - math.log(2 * math.exp(b) + 1) - math.log(math.exp(b) + 1))
    f = models.logistic(one, yb, names)
    lo, hi = models.profile_limits(one, yb, f, 1)
    assert lo < f.beta[1] < hi and hi - lo == pytest.approx(2 * 1.96 * f.se[1], rel=0.1)


def test_regression_frames(spark):
    rng = np.random.default_rng(1)
    n = 200
    p = pd.DataFrame({"age": rng.normal(60, 9, n), "sex": rng.choice(["F", "M"], n), "bmi": rng.normal(25, 3, n), "site": rng.integers(1, 4, n)})
    p["dead"] = (rng.random(n) < 1 / (1 + np.exp(-(p["age"] - 60) / 9))).astype(int)
    p["time"] = rng.exponential(10, n).round(1) + 0.1
    spec, surv = regression.ModelSpec("dead"), regression.ModelSpec("dead", time="time", covars=("sex",))
    scan = regression.regression_scan(spark.createDataFrame(p), spec, ["age", "bmi", "sex"])
    assert scan["predictor"][0] == "age" and scan["best.var.trans"].notna().all() and scan["original.padj"][0] == pytest.approx(3 * scan["original.p"][0], rel=1e-6)
    assert len(regression.interaction_scan(spark.createDataFrame(p), spec, ["age", "bmi"], ["sex"])) == 2
    forest = regression.regression_forest(p, surv, ["age", "sex"])
    assert list(forest["text"])[1] == "Reference"
    sub = regression.subgroup_forest(p, spec, "age", ["sex"])
    assert list(sub["percent"])[0] == 100 and sub["n"].iloc[2:].sum() == n
    curve = regression.predictor_effect_plot(p, surv, "age", knot=None)
    assert set(curve["details"]["aic"]) == {3, 4, 5, 6, 7} and (curve["curve"]["lower"] <= curve["curve"]["upper"]).all()
    assert regression.break_at((0, 10), 5, 3) == pytest.approx([-2, 0.5, 3, 5.5, 8, 10.5])
    assert regression.formula_add_covs("y ~ x", ["a", "b c"]) == "y ~ x + a + `b c`"
    assert regression.ModelSpec("s", "t", covars=("z",)).formula("x") == "Surv(t, s) ~ x + z"


def test_classification_and_survival(spark):
    d = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.8), (0, 0.3), (1, 0.4), (0, 0.1)], "y int, m double")
    s = classification.stack(d, "y", ["m"])
    r = classification.classif_metrics(s).first()
    assert r.auc == pytest.approx((3 + 2.5 + 2) / 9)
    with pytest.raises(ValueError):
        classification.stack(d.withColumn("m", F.col("m") * 3), "y", ["m"])
    surv = spark.createDataFrame([(1.0, 1, 5.0), (2.0, 0, 3.0), (2.0, 1, 4.0), (3.0, 1, 1.0)], "t double, e int, m double")
    assert [round(x.surv, 6) for x in survival.km_curve(surv, "t", "e").orderBy("time").collect()] == [0.75, 0.5, 0.0]
    assert survival.calc_cindex(surv, "t", "e", "m") == 1.0
    with pytest.warns(UserWarning):
        assert survival.calc_cindex(surv.withColumn("m", -F.col("m")), "t", "e", "m") == 1.0
    auc, curve = survival.time_roc(surv, "t", "e", "m", (2,))
    assert auc["auc"][0] == pytest.approx(1.0) and curve.count() == 4
    imp = classification.importance_plot({"a": 0.5, "b": 0.960180306, "c": 0.1}, top_n=2)
    assert list(imp["label"]) == ["9.6e-01", "5.0e-01", "..."]


def test_normality_and_table1(spark):
    assert normality.alpha_by_n(500) == pytest.approx(5.431508e-06, rel=1e-6)
    rng = np.random.default_rng(2)
    assert normality.test_normality(rng.normal(size=80)) and not normality.test_normality(rng.exponential(size=80))
    # a published example: weights of eleven men
    assert normality.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], float)) == pytest.approx(0.006704, rel=2e-2)
    with pytest.warns(UserWarning):
        assert normality.test_normality([1, 2]) is False
    assert baseline.fisher(np.array([[3, 1], [1, 3]])) == pytest.approx(0.4857143, rel=1e-6)
    assert baseline.kruskal(np.array([3.0, 3.0]), np.array([6.0, 15.0]), 0, 6) == pytest.approx(chi2_sf(3.857143, 1), rel=1e-5)
    p = pd.DataFrame({"g": ["a", "b", "c"] * 30, "v": rng.normal(size=90), "k": rng.exponential(size=90), "f": rng.choice(["x", "y"], 90)})
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        t = baseline.baseline_table(spark.createDataFrame(p), "g", smd=False)
    assert list(t["baseline"][""])[0] == "n" and t["pairwise"] is not None and len(t["missing"]) == 3


def test_stream(spark, tmp_path):
    from clinloom.streaming.range_stream import stream_by_range

    ranges = spark.createDataFrame([(1, 0, 10, "w1")], "g int, s int, e int, ward string")
    spark.createDataFrame([(1, 5, "2024-01-01 00:00:00"), (1, 5, "2024-01-01 00:00:00"), (1, 50, "2024-01-01 00:01:00")], "g int, v int, at string").withColumn("at", F.col("at").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    points = spark.readStream.schema("g int, v int, at timestamp").parquet(str(tmp_path / "in"))
    q = stream_by_range(points, ranges, "g", "s", "e", "v", "at", unique=["g", "v"]).writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        q.processAllAvailable()
        assert [(r.ward, r.since_start) for r in spark.sql("SELECT * FROM streamed").collect()] == [("w1", 5)]
    finally:
        q.stop()


def test_anchor_by_text_that_is_no_number(spark):
    rows = [(1, "9", 0), (1, "10", 1), (1, "11", 0), (1, "8", 0), (2, "7", 1)]
    kept = {}
    for extra in ([], [(3, "x", 0)]):
        visit = spark.createDataFrame(rows + extra, "patient_id int, visit_id string, hit int")
        out = screening.screen_data_list({"visit": visit}, screening.any_("visit", "true"), anchor=screening.any_("visit", "hit = 1"), anchor_level="visit_id", patient_id_map="patient_id", visit_id_map="visit_id")
        kept[len(extra)] = {(r.patient_id, r.visit_id) for r in out.data["visit"].collect()}
    assert kept[0] == {(1, "10"), (1, "11"), (2, "7")}
    assert kept[1] == kept[0] | {(1, "9"), (1, "8")}  # one visit that is no number: all compare as text


def test_covariates_in_conflict():
    with pytest.warns(UserWarning, match="age"):
        assert regression.remove_conflict(("age", "sex"), ("age",)) == ("sex",)
    assert regression.remove_conflict(("age",), ("age",), warn=False) == ()


def test_concordance_against_all_pairs(spark):
    rng = random.Random(8)
    for n, times in ((40, 6), (60, 1000), (1, 3)):
        rows = [(float(rng.randrange(times)), rng.randrange(2), float(rng.randrange(12))) for _ in range(n)]
        got = survival.concordance(spark.createDataFrame([*rows, (None, 1, 1.0), (1.0, 1, None)], "t double, e int, m double"), "t", "e", "m").first()
        pairs = [(m, w) for t, e, m in rows if e for u, f, w in rows if u > t or (u == t and not f)]
        assert tuple(got) == (len(pairs), sum(m > w for m, w in pairs), sum(m == w for m, w in pairs))


def test_concordance_deals_a_row_twice(spark):
    rng, count = random.Random(9), survival._count_pairs
    rows = [(float(rng.choice([3, rng.randrange(40)])), rng.randrange(2), float(rng.choice([5, rng.randrange(60)]))) for _ in range(300)]
    pairs = [(m, w) for t, e, m in rows if e for u, f, w in rows if u > t or (u == t and not f)]
    want = (len(pairs), sum(m > w for m, w in pairs), sum(m == w for m, w in pairs))
    df = spark.createDataFrame(rows, "t double, e int, m double")
    for cuts in (1, 2, 5, 128):
        assert tuple(survival.concordance(df, "t", "e", "m", cuts).first()) == want
    a = [np.array(x) for x in zip(*rows)]
    got = count(2 * a[0].astype(int) + 1 - a[1], a[2], a[1] == 1, np.ones(300, dtype=np.int64))
    assert got == want
    plan = survival.concordance(df, "t", "e", "m")._jdf.queryExecution().toString()
    assert "Generate" not in plan  # no copy of a row a level
    assert survival.concordance(df.limit(0), "t", "e", "m").first() == (0, 0, 0)
