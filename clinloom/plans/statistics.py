"""Queries of profiling, statistics, models, sources and encodings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinloom.operators import baseline, batched, classification, encoding, models, normality, overview, quality, regression, subset, survival
from clinloom.plans.tables import HOLED, holed, table
from clinloom.sources import files

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Two models of "quality is 0": by length, and by number, of a document.
_SCORES = """s AS (SELECT CAST(1 - quality AS INT) AS y, (n_chars % 1000) / 1000.0::DOUBLE AS a, (documents.doc_id % 97) / 97.0::DOUBLE AS b FROM labels JOIN documents ON labels.doc_id = documents.doc_id),
 l AS (SELECT 'a' AS model, y, a AS p FROM s UNION ALL SELECT 'b', y, b FROM s)"""
_ROC = f"""{_SCORES}, c AS (SELECT model, p AS threshold, sum(y) AS pos, sum(1 - y) AS neg FROM l GROUP BY 1, 2),
 r AS (SELECT model, threshold, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp, CAST(sum(pos) OVER (PARTITION BY model) AS BIGINT) AS "P", CAST(sum(neg) OVER (PARTITION BY model) AS BIGINT) AS "N"
  FROM c WINDOW w AS (PARTITION BY model ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _scores(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    s = s.select((1 - F.col("quality")).cast("int").alias("y"), (F.col("n_chars") % 1000 / F.lit(1000.0)).alias("a"), (F.col("doc_id") % 97 / F.lit(97.0)).alias("b"))
    return classification.stack(s, "y", ["a", "b"])


@query(f'WITH {_ROC} SELECT model, threshold, tp, fp, "P", "N" FROM r')
def roc_table(spark: SparkSession, d: str) -> DataFrame:
    return classification.roc_table(_scores(spark, d)).drop("pos", "neg")


@query(f'WITH {_ROC} SELECT model, round(threshold, 9) AS threshold, round(tp / "P", 9) AS recall, round(tp / (tp + fp), 9) AS precision FROM r')
def pr_curve(spark: SparkSession, d: str) -> DataFrame:
    out = classification.pr_curve(_scores(spark, d))
    return out.select("model", *[F.round(c, 9).alias(c) for c in ("threshold", "recall", "precision")])


@query(f"""WITH {_ROC}, j AS (SELECT *, tp / "P" - fp / "N" AS j FROM r), m AS (SELECT model, max(round(j, 12)) AS top FROM j GROUP BY 1), k AS (SELECT j.model, max(threshold) AS t FROM j JOIN m ON j.model = m.model AND round(j, 12) = top GROUP BY 1),
 b AS (SELECT j.* FROM j JOIN k ON j.model = k.model AND threshold = t), a AS (SELECT model, sum(pos * ("N" - fp + neg / 2)) / max("P") / max("N") AS auc FROM r GROUP BY 1), q AS (SELECT model, avg((p - y) * (p - y)) AS brier FROM l GROUP BY 1)
 SELECT b.model, round(auc, 6) AS auc, round((tp + "N" - fp) / ("P" + "N"), 6) AS accuracy, round(tp / "P", 6) AS sensitivity, round(("N" - fp) / "N", 6) AS specificity, round(tp / (tp + fp), 6) AS ppv,
 round(("N" - fp) / ("N" - fp + "P" - tp), 6) AS npv, round(2 * tp / (2 * tp + fp + "P" - tp), 6) AS f1, round(brier, 6) AS brier, round(threshold, 6) AS cutoff, round(j, 6) AS youden FROM b JOIN a ON b.model = a.model JOIN q ON b.model = q.model""")
def classif_metrics(spark: SparkSession, d: str) -> DataFrame:
    return classification.classif_metrics(_scores(spark, d), digits=6).select("model", "auc", "accuracy", "sensitivity", "specificity", "ppv", "npv", "f1", "brier", "cutoff", "youden")


@query(f"""WITH {_SCORES}, t AS (SELECT unnest([0.1, 0.2, 0.3, 0.4]) :: DOUBLE AS threshold), n AS (SELECT model, count(*) AS n, sum(y) AS k FROM l GROUP BY 1)
 SELECT l.model, threshold, round(count(*) FILTER (WHERE p >= threshold AND y = 1) / max(n) - count(*) FILTER (WHERE p >= threshold AND y = 0) / max(n) * (threshold / (1 - threshold)), 9) AS net_benefit,
 round(max(k) / max(n) - (1 - max(k) / max(n)) * (threshold / (1 - threshold)), 9) AS treat_all FROM l JOIN n ON l.model = n.model, t GROUP BY l.model, threshold""")
def dca(spark: SparkSession, d: str) -> DataFrame:
    out = classification.dca(_scores(spark, d), [0.1, 0.2, 0.3, 0.4])
    return out.select("model", "threshold", F.round("net_benefit", 9).alias("net_benefit"), F.round("treat_all", 9).alias("treat_all"))


@query(f"WITH {_SCORES} SELECT model, CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(p), 9) AS predicted, round(avg(y), 9) AS observed FROM l GROUP BY 1, 2")
def calibration(spark: SparkSession, d: str) -> DataFrame:
    out = classification.calibration(_scores(spark, d))
    return out.select("model", "bin", "n", F.round("predicted", 9).alias("predicted"), F.round("observed", 9).alias("observed"))


@query()
def classif_model_compare(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select((1 - F.col("quality")).alias("y"), (F.col("n_chars") % 1000 / 1000).alias("a"), (F.col("doc_id") % 97 / 97).alias("b"))
    return regression.to_spark(spark, classification.classif_model_compare(s, "y", ["a", "b"])[0])


# Orders as subjects: days since a start, event when delivered, marker the price.
_SURV = "v AS (SELECT CAST(o_orderkey % 211 + 1 AS DOUBLE) AS t, CAST(o_orderstatus = 'F' AS INT) AS e, o_orderpriority AS g, o_totalprice AS m, o_orderkey FROM orders)"


def _surv(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select((F.col("o_orderkey") % 211 + 1).cast("double").alias("t"), (F.col("o_orderstatus") == "F").cast("int").alias("e"), F.col("o_orderpriority").alias("g"), F.col("o_totalprice").alias("m"), "o_orderkey")


@query(f"""WITH {_SURV}, c AS (SELECT g, t, count(*) AS n, sum(e) AS d FROM v GROUP BY 1, 2),
 r AS (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM c)
 SELECT g, t AS time, CAST(k AS BIGINT) AS n_risk, CAST(d AS BIGINT) AS n_event, CAST(n - d AS BIGINT) AS n_censor,
 round(product(1 - d / k) OVER (PARTITION BY g ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 8) AS surv FROM r""")
def km_curve(spark: SparkSession, d: str) -> DataFrame:
    return survival.km_curve(_surv(spark, d), "t", "e", ["g"]).select("g", "time", "n_risk", "n_event", "n_censor", F.round("surv", 8).alias("surv"))


@query(f"""WITH {_SURV}, s AS (SELECT * FROM v)
 SELECT count(*) AS pairs, count(*) FILTER (WHERE a.m > b.m) AS concordant, count(*) FILTER (WHERE a.m = b.m) AS tied FROM s a JOIN s b ON a.e = 1 AND (a.t < b.t OR (a.t = b.t AND b.e = 0))""")
def cindex(spark: SparkSession, d: str) -> DataFrame:
    return survival.concordance(_surv(spark, d), "t", "e", "m")


@query()
def logrank(spark: SparkSession, d: str) -> DataFrame:
    r = survival.logrank(_surv(spark, d), "t", "e", "g")
    return spark.createDataFrame([(str(g), float(o), float(e), r["statistic"], r["p"]) for g, o, e in zip(r["groups"], r["observed"], r["expected"])], "grp string, observed double, expected double, statistic double, p double")


@query(f"""WITH {_SURV}, c AS (SELECT t, g, count(*) AS n, sum(e) AS d FROM v GROUP BY 1, 2), k AS (SELECT t, g, coalesce(n, 0) AS n, coalesce(d, 0) AS d FROM (SELECT DISTINCT t FROM v) CROSS JOIN (SELECT DISTINCT g FROM v) LEFT JOIN c USING (t, g)),
 r AS (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ng FROM k), s AS (SELECT *, sum(ng) OVER (PARTITION BY t) AS na, sum(d) OVER (PARTITION BY t) AS da FROM r)
 SELECT g AS grp, CAST(sum(d) AS DOUBLE) AS observed, round(sum(da * ng / na), 6) AS expected FROM s GROUP BY 1""")
def logrank_expected(spark: SparkSession, d: str) -> DataFrame:
    """What the test compares: events by group, and those expected if all groups were alike."""
    return logrank(spark, d).select("grp", "observed", F.round("expected", 6).alias("expected"))


@query(f"""WITH {_SURV}, c AS (SELECT t, count(*) AS n, sum(1 - e) AS d FROM v GROUP BY 1), r AS (SELECT *, sum(n) OVER (ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM c),
 g AS (SELECT t, product(1 - d / k) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM r), b AS (SELECT t, s, coalesce(lag(s) OVER (ORDER BY t), 1.0) AS before FROM g),
 u AS (SELECT unnest([60.0, 120.0])::DOUBLE AS until), gu AS (SELECT until, coalesce(min(s), 1.0) AS gs FROM u LEFT JOIN b ON b.t <= until GROUP BY 1),
 w AS (SELECT until, m, CASE WHEN v.t <= until AND e = 1 THEN 1 / before ELSE 0 END AS c, CASE WHEN v.t > until THEN 1 / gs ELSE 0 END AS n FROM v JOIN b ON v.t = b.t CROSS JOIN gu), q AS (SELECT until, m, sum(c) AS c, sum(n) AS n FROM w GROUP BY 1, 2)
 SELECT until AS time, m AS threshold, round(sum(c) OVER o / sum(c) OVER (PARTITION BY until), 6) AS tpr, round(sum(n) OVER o / sum(n) OVER (PARTITION BY until), 6) AS fpr FROM q WINDOW o AS (PARTITION BY until ORDER BY m DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def time_roc(spark: SparkSession, d: str) -> DataFrame:
    curve = survival.time_roc(_surv(spark, d), "t", "e", "m", (60, 120))[1]
    return curve.select("time", "threshold", *[F.round(c, 6).alias(c) for c in ("tpr", "fpr")])


@query("""WITH v AS (SELECT (o_orderkey % 211 + 1)::DOUBLE AS t, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 0 END AS e, o_totalprice AS m FROM orders),
 c AS (SELECT t, count(*) AS n, count(*) FILTER (WHERE e = 0) AS d FROM v GROUP BY 1), r AS (SELECT *, sum(n) OVER (ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM c),
 g AS (SELECT t, product(1 - d / k) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM r), b AS (SELECT t, s, coalesce(lag(s) OVER (ORDER BY t), 1.0) AS before FROM g),
 u AS (SELECT unnest([60.0, 120.0])::DOUBLE AS until), gu AS (SELECT until, coalesce(min(s), 1.0) AS gs FROM u LEFT JOIN b ON b.t <= until GROUP BY 1), f AS (SELECT unnest([true, false]) AS free),
 w AS (SELECT until, free, m, CASE WHEN v.t <= until AND e = 1 THEN 1 / before ELSE 0 END AS c, CASE WHEN v.t > until THEN 1 / gs WHEN NOT free AND e = 2 THEN 1 / before ELSE 0 END AS n FROM v JOIN b ON v.t = b.t CROSS JOIN gu CROSS JOIN f),
 q AS (SELECT until, free, m, sum(c) AS c, sum(n) AS n FROM w GROUP BY 1, 2, 3),
 z AS (SELECT *, sum(n) OVER (PARTITION BY until, free ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS below FROM q)
 SELECT until AS time, free, round(sum(c * (below + n / 2)) / sum(c) / sum(n), 6) AS auc FROM z GROUP BY 1, 2""")
def time_roc_causes(spark: SparkSession, d: str) -> DataFrame:
    """AUC of one of two causes, rows of the other left out or taken as controls."""
    cause = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "P", 2).otherwise(0)
    v = table(spark, d, "orders").select((F.col("o_orderkey") % 211 + 1).cast("double").alias("t"), cause.alias("e"), F.col("o_totalprice").alias("m"))
    return survival.time_auc(v, "t", "e", "m", (60, 120), cause=1).select("time", "free", F.round("auc", 6).alias("auc"))


@query("""SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem""")
def ols_fit(spark: SparkSession, d: str) -> DataFrame:
    f = models.fit_ols(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])
    return spark.createDataFrame([(round(float(f.beta[1]), 4), round(float(f.beta[0]), 3), f.n)], "slope double, intercept double, n long")


def _fit_rows(spark: SparkSession, fit: models.Fit) -> DataFrame:
    return regression.to_spark(spark, pd.DataFrame(fit.table()))


@query()
def logistic_fit(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_totalprice") / 1e5).alias("price"), (F.col("o_orderkey") % 10).alias("k"))
    return _fit_rows(spark, models.fit_logistic(o, "y", ["price", "k"]))


@query()
def cox_fit(spark: SparkSession, d: str) -> DataFrame:
    s = _surv(spark, d).withColumn("m", F.col("m") / 1e5)
    return _fit_rows(spark, models.fit_cox(s, "t", "e", ["m"]))


@query()
def proportional_hazards(spark: SparkSession, d: str) -> DataFrame:
    """Whether the hazard ratios of two columns change with time."""
    s = _surv(spark, d).select("t", "e", (F.col("m") / 1e5).alias("m"), (F.col("o_orderkey") % 7).alias("k"))
    return spark.createDataFrame([(r["term"], r["chisq"], r["df"], r["p"]) for r in survival.proportional_hazards(s, "t", "e", ["m", "k"])], "term string, chisq double, df int, p double")


def _cohort(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select((F.col("c_custkey") % 3 == 0).cast("int").alias("y"), "c_acctbal", (F.col("c_custkey") % 50 + 1).alias("age"), "c_mktsegment", (F.col("c_nationkey") % 4).alias("site"))


@query()
def regression_scan(spark: SparkSession, d: str) -> DataFrame:
    return regression.to_spark(spark, regression.regression_scan(_cohort(spark, d), regression.ModelSpec("y")))


@query()
def regression_fit(spark: SparkSession, d: str) -> DataFrame:
    """The model of a yes or no, with limits of the profile likelihood."""
    return regression.to_spark(spark, pd.DataFrame(regression.regression_fit(_cohort(spark, d), regression.ModelSpec("y", covars=("c_mktsegment",)), "age", returned="full")))


@query()
def rcs_plot(spark: SparkSession, d: str) -> DataFrame:
    return regression.to_spark(spark, regression.rcs_plot(_cohort(spark, d), regression.ModelSpec("y"), "age", knot=None)["curve"])


@query()
def interaction_p_value(spark: SparkSession, d: str) -> DataFrame:
    p = regression.interaction_p_value(_cohort(spark, d), regression.ModelSpec("y"), "age", "site")
    return spark.createDataFrame([(p,)], "p double")


_LINEAR = ("age", "site", "y")


@query(" UNION ALL ".join(f"""SELECT '{c}' AS term, round(b, 6) AS estimate, round(se, 6) AS std_error, round(b / se, 6) AS statistic, n FROM (SELECT regr_slope(x, {c}) AS b, sqrt(regr_syy(x, {c}) * (1 - regr_r2(x, {c})) / regr_sxx(x, {c}) / (regr_count(x, {c}) - 2)) AS se, CAST(regr_count(x, {c}) AS BIGINT) AS n
 FROM (SELECT c_acctbal AS x, CAST(c_custkey % 50 + 1 AS DOUBLE) AS age, CAST(c_nationkey % 4 AS DOUBLE) AS site, CAST(c_custkey % 3 = 0 AS DOUBLE) AS y FROM customer))""" for c in _LINEAR))
def linear_fits(spark: SparkSession, d: str) -> DataFrame:
    """Linear models of the account balance, one a column, fitted side by side."""
    made = [batched.Model("linear", batched.Term("value", "c_acctbal"), (c,), (batched.Term("value", c),), ("c_acctbal", c)) for c in _LINEAR]
    fits = batched.fit_many(_cohort(spark, d), made)
    rows = [(c, *(round(float(r[k]), 6) for k in ("estimate", "std_error", "statistic")), f.n) for c, f in zip(_LINEAR, fits) for r in f.table()[1:]]
    return spark.createDataFrame(rows, "term string, estimate double, std_error double, statistic double, n long")


@query()
def interaction_scan(spark: SparkSession, d: str) -> DataFrame:
    return regression.to_spark(spark, regression.interaction_scan(_cohort(spark, d), regression.ModelSpec("y"), ["c_acctbal", "age"], ["c_mktsegment", "site"]))


@query()
def regression_basic_results(spark: SparkSession, d: str) -> DataFrame:
    return regression.to_spark(spark, regression.regression_basic_results(_cohort(spark, d), regression.ModelSpec("y"), "age", {"Adjusted": ["c_acctbal"]}))


@query()
def regression_forest(spark: SparkSession, d: str) -> DataFrame:
    return regression.to_spark(spark, regression.regression_forest(_cohort(spark, d), regression.ModelSpec("y"), ["age", "c_mktsegment"]))


@query()
def subgroup_forest(spark: SparkSession, d: str) -> DataFrame:
    return regression.to_spark(spark, regression.subgroup_forest(_cohort(spark, d), regression.ModelSpec("y"), "age", ["site", "c_mktsegment"]))


@query()
def predictor_effect_plot(spark: SparkSession, d: str) -> DataFrame:
    return regression.to_spark(spark, regression.predictor_effect_plot(_cohort(spark, d), regression.ModelSpec("y"), "age")["curve"])


@query()
def interaction_plot(spark: SparkSession, d: str) -> DataFrame:
    return regression.to_spark(spark, regression.interaction_plot(_cohort(spark, d), regression.ModelSpec("y"), "age", "site"))


@query("""SELECT s, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS median FROM
 (SELECT c_mktsegment AS s, c_acctbal AS x FROM customer UNION ALL SELECT NULL, c_acctbal FROM customer) GROUP BY s""")
def table1_numeric(spark: SparkSession, d: str) -> DataFrame:
    out = baseline.summaries(table(spark, d, "customer"), ["c_acctbal"], "c_mktsegment")
    return regression.to_spark(spark, out[["s", "n", "mean", "sd", "q1", "median"]].round(6))


@query("SELECT c_mktsegment AS s, CAST(c_nationkey % 4 AS VARCHAR) AS level, count(*) AS n FROM customer GROUP BY 1, 2")
def table1_counts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumn("site", F.col("c_nationkey") % 4)
    return regression.to_spark(spark, baseline.level_counts(c, ["site"], "c_mktsegment")[["s", "level", "n"]])


@query()
def baseline_table(spark: SparkSession, d: str) -> DataFrame:
    c = _cohort(spark, d).drop("y")
    return regression.to_spark(spark, baseline.baseline_table(c, "c_mktsegment")["baseline"].rename(columns={"": "item"}))


@query()
def get_var_types(spark: SparkSession, d: str) -> DataFrame:
    v = normality.get_var_types(_cohort(spark, d), "c_mktsegment")
    rows = [(k, x) for k in ("factor_vars", "exact_vars", "nonnormal_vars", "omit_vars") for x in getattr(v, k)]
    return spark.createDataFrame(rows, "kind string, variable string")


@query("""SELECT variable, count(x) AS n, count(*) - count(x) AS missing, round(avg(x), 2) AS mean, round(quantile_cont(x, 0.5), 2) AS median, round(min(x), 2) AS min, round(max(x), 2) AS max, round(stddev_samp(x), 2) AS sd FROM
 (SELECT 'value' AS variable, value AS x FROM (""" + HOLED + """) UNION ALL SELECT 'user_id', user_id FROM events) GROUP BY 1""")
def data_overview_numeric(spark: SparkSession, d: str) -> DataFrame:
    return overview.numeric_profile(holed(spark, d).select("value", "user_id")).drop("missing_pct")


@query("""WITH c AS (SELECT 'c_mktsegment' AS variable, c_mktsegment AS v, count(*) AS n FROM customer GROUP BY 2), t AS (SELECT variable, max(n) AS k, sum(n) AS n, count(*) AS u FROM c GROUP BY 1)
 SELECT t.variable, CAST(t.n AS BIGINT) AS n, CAST(u AS BIGINT) AS "unique", min(v) AS top_value, CAST(k AS BIGINT) AS top_freq FROM t JOIN c ON c.n = k GROUP BY ALL""")
def data_overview_character(spark: SparkSession, d: str) -> DataFrame:
    return overview.character_profile(table(spark, d, "customer").select("c_mktsegment")).select("variable", "n", "unique", "top_value", "top_freq")


@query("""WITH h AS (""" + HOLED + """), q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM h)
 SELECT * FROM (SELECT 'missing_values' AS issue, 'value' AS variable, 'missing_pct' AS metric, round(100 * avg(CAST(value IS NULL AS DOUBLE)), 2) AS value FROM h
 UNION ALL SELECT 'outliers', 'value', 'outlier_count', CAST(count(*) FILTER (WHERE value < a - 0.5 * (b - a) OR value > b + 0.5 * (b - a)) AS DOUBLE) FROM h, q
 UNION ALL SELECT 'outliers', 'flag', 'outlier_count', CAST(count(*) FILTER (WHERE event_id % 2 = 9) AS DOUBLE) FROM h
 UNION ALL SELECT 'numeric_as_character', 'txt', 'convertible', CAST(count(*) FILTER (WHERE event_id % 4 <> 0) AS DOUBLE) FROM h
 UNION ALL SELECT 'low_cardinality', 'kind', 'distinct', 3.0
 UNION ALL SELECT 'case_issues', 'txt', 'folded', CAST(count(DISTINCT CASE WHEN event_id % 4 = 0 THEN 'ab' ELSE CAST(event_id % 50 AS VARCHAR) END) AS DOUBLE) FROM h
 UNION ALL SELECT 'duplicate_rows', '*', 'n', CAST((SELECT count(*) FROM h) - (SELECT count(*) FROM (SELECT DISTINCT value, event_id % 2, CASE event_id % 8 WHEN 0 THEN 'ab' WHEN 4 THEN 'AB' ELSE CAST(event_id % 50 AS VARCHAR) END, event_id % 3 + 1 FROM h)) AS DOUBLE))
 WHERE value > 0""")
def data_overview_issues(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    txt = F.when(k % 8 == 0, "ab").when(k % 8 == 4, "AB").otherwise((k % 50).cast("string"))
    h = holed(spark, d).select("value", (k % 2).alias("flag"), txt.alias("txt"), (k % 3 + 1).alias("kind"))
    return overview.quality_issues(h, "iqr", 0.5, current_year=2030)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def combine_files(spark: SparkSession, d: str) -> DataFrame:
    """Nations in two files that overlap, written as CSV and read as one."""
    root = files.shared_root(spark)
    path = f"{root}/combine-{spark.sparkContext.applicationId}-{id(d)}"
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    n.where("n_nationkey < 15").unionAll(n.where("n_nationkey >= 10")).coalesce(2).write.mode("overwrite").option("header", True).csv(path)
    out = files.combine_files(spark, path, r"\.csv$")
    return out.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, d, "events").select("event_id", *[F.when(F.pmod(F.hash(k, F.lit(i)), F.lit(10)) < i, None).otherwise(F.col("value")).alias(f"v{i}") for i in range(8)])


@query()
def get_valid_subset(spark: SparkSession, d: str) -> DataFrame:
    return subset.get_valid_subset(_gaps(spark, d), "event_id", row_na_ratio=0.3, col_na_ratio=0.3)


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'é' || lang ELSE lang END AS txt FROM documents")
def auto_encoding_repair(spark: SparkSession, d: str) -> DataFrame:
    latin = F.concat(F.unhex(F.lit("E9")), F.encode(F.col("lang"), "ISO-8859-1"))
    raw = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, latin).otherwise(F.encode("lang", "UTF-8")).alias("txt"))
    return encoding.auto_encoding_repair(raw, "txt", "latin-1")


@query("SELECT 'c_acctbal' AS variable UNION ALL SELECT 'c_custkey' UNION ALL SELECT 'c_nationkey'")
def filter_rcs_predictors(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(c,) for c in quality.filter_rcs_predictors(table(spark, d, "customer"))], "variable string")
