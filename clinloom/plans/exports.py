"""Queries of the small exports: names and lists, formulas and breaks, p-values, rules as text, single quality issues, result tables."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinloom.functions import distributions, names
from clinloom.operators import classification, normality, overview, regression
from clinloom.operators.screen_text import parse_rule
from clinloom.operators.substring_join import make_name, unmake_names as _unmake
from clinloom.plans import cohort
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


def _nations(spark: SparkSession, d: str) -> list[tuple]:
    """The 25 nations, in the order of their keys."""
    return [tuple(r) for r in table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()]


@query("SELECT CAST(n_regionkey AS INT) AS region, 'c(' || string_agg('''' || n_name || '''', ', ' ORDER BY n_nationkey) || ')' AS code FROM nation GROUP BY 1")
def vec2code(spark: SparkSession, d: str) -> DataFrame:
    by: dict[int, list[str]] = {}
    for _, name, region in _nations(spark, d):
        by.setdefault(region, []).append(name)
    return spark.createDataFrame([(k, names.vec2code(v)) for k, v in by.items()], "region int, code string")


@query("SELECT 'c(' || string_agg('''' || column_name || '''', ', ' ORDER BY column_index) || ')' AS code FROM duckdb_columns() WHERE table_name = 'region'")
def name2code(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(names.name2code(table(spark, d, "region")),)], "code string")


@query("""WITH i AS (SELECT unnest(range(1, 40)) AS i), p AS (SELECT c_nationkey AS k, i, min(left(c_name, i)) AS a, max(left(c_name, i)) AS b, min(length(c_name)) AS n FROM customer, i GROUP BY 1, 2)
 SELECT CAST(k AS BIGINT) AS k, coalesce(max(a) FILTER (WHERE a = b AND i <= n), '') AS prefix FROM p GROUP BY 1""")
def common_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("k")).agg(names.common_prefix_of("c_name").alias("prefix"))


@query("SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def add_lists(spark: SparkSession, d: str) -> DataFrame:
    """Counts by type of even and of odd events, as maps, added."""
    e = table(spark, d, "events").withColumn("odd", F.col("event_id") % 2 == 1)
    counts = e.groupBy("user_id", "event_type", "odd").agg(F.count("*").alias("n"))
    own = lambda odd: F.map_from_entries(F.collect_list(F.when(F.col("odd") == odd, F.struct("event_type", "n"))))
    both = counts.groupBy("user_id").agg(own(False).alias("a"), own(True).alias("b"))
    return both.select("user_id", F.explode(names.add_maps("a", "b")).alias("event_type", "n"))


@query("SELECT * FROM (VALUES (0, 'z'), (1, 'x'), (2, 'y'), (3, 'w')) t(place, item)")
def merge_ordered_vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(names.merge_ordered_vectors([["x", "y"], ["z", "x"], ["z", "w"]]))), "place int, item string")


@query("SELECT * FROM (VALUES (0, '#66C2A5'), (1, '#FC8D62'), (2, '#8DA0CB'), (3, '#E78AC3'), (4, '#A6D854'), (5, '#FFD92F'), (6, '#E5C494'), (7, '#B3B3B3'), (8, '#ad4c5e'), (9, '#474747')) t(place, color)")
def emp_colors(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(names.EMP_COLORS)), "place int, color string")


@query("SELECT regexp_replace(n_name, '[^A-Za-z0-9_.]', '.', 'g') AS syntactic, n_name AS original FROM nation UNION ALL SELECT 'not.there', NULL")
def unmake_names(spark: SparkSession, d: str) -> DataFrame:
    have = [n for _, n, _ in _nations(spark, d)]
    asked = [*map(make_name, have), "not.there"]
    return spark.createDataFrame(list(zip(asked, _unmake(asked, have))), "syntactic string, original string")


@query("""WITH r AS (SELECT CAST(min(n_nationkey) AS DOUBLE) AS lo, CAST(max(n_nationkey) AS DOUBLE) AS hi FROM nation), i AS (SELECT unnest(range(0, 5)) AS i)
 SELECT 'plain' AS kind, CAST(i AS INT) AS place, lo + (hi - lo) / 4 * i AS at FROM r, i
 UNION ALL SELECT 'met', CAST(i AS INT), lo + (7 - lo) % ((hi - lo) / 3) + (hi - lo) / 3 * (i - 1) FROM r, i""")
def break_at(spark: SparkSession, d: str) -> DataFrame:
    keys = [float(k) for k, _, _ in _nations(spark, d)]
    lim = (min(keys), max(keys))
    rows = [(kind, i, float(v)) for kind, got in (("plain", regression.break_at(lim, 4)), ("met", regression.break_at(lim, 4, 7.0))) for i, v in enumerate(got)]
    return spark.createDataFrame(rows, "kind string, place int, at double")


@query("SELECT 'y ~ x + r_regionkey + r_name + `a b`' AS formula")
def formula_add_covs(spark: SparkSession, d: str) -> DataFrame:
    covs = [c for c in table(spark, d, "region").columns if c in ("r_regionkey", "r_name")]
    return spark.createDataFrame([(regression.formula_add_covs("y ~ x", [*covs, "a b"]),)], "formula string")


@query("""WITH s AS (SELECT event_type AS name, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY value DESC, name) AS k FROM s)
 SELECT name, value, format('{:.1e}', value) AS label FROM r WHERE k <= 2 UNION ALL SELECT '...', NULL, '...'""")
def importance_plot(spark: SparkSession, d: str) -> DataFrame:
    scores = {r.name: float(r.n) for r in table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n")).orderBy("name").collect()}
    return regression.to_spark(spark, classification.importance_plot(scores, top_n=2)).select("name", F.col("value").cast("double").alias("value"), "label")


@query("""WITH p AS (SELECT CAST(n_nationkey AS INT) AS k, ((n_nationkey * 7) % 25 + 1) / 40.0::DOUBLE AS p FROM nation), r AS (SELECT *, row_number() OVER (ORDER BY p) AS i FROM p)
 SELECT k, p, least(1.0, min((25.0::DOUBLE / i) * p) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS bh,
  least(1.0, max((25 - i + 1) * p) OVER (ORDER BY i)) AS holm, least(1.0, min((25 - i + 1) * p) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS hochberg, least(1.0, p * 25) AS bonferroni FROM r""")
def p_adjust(spark: SparkSession, d: str) -> DataFrame:
    keys = [k for k, _, _ in _nations(spark, d)]
    p = [((k * 7) % 25 + 1) / 40.0 for k in keys]
    cols = [distributions.adjust(p, m) for m in ("BH", "holm", "hochberg", "bonferroni")]
    return spark.createDataFrame(list(zip(map(int, keys), p, *cols)), "k int, p double, bh double, holm double, hochberg double, bonferroni double")


@query("SELECT CAST(n AS INT) AS n, round(CASE WHEN n < 100 THEN 0.05::DOUBLE ELSE pow(10, log10(0.05) * exp(2 * (log10(n) - 2))) END, 12) AS alpha FROM (VALUES (10), (99), (100), (250), (1000)) t(n)")
def alpha_by_n(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(n, round(float(normality.alpha_by_n(n)), 12)) for n in (10, 99, 100, 250, 1000)], "n int, alpha double")


_BALANCES = "SELECT c_nationkey, CAST(round(sum(CAST(c_acctbal AS DOUBLE)), 2) AS DOUBLE) AS x FROM customer GROUP BY 1"


@query(f"SELECT CAST(row_number() OVER (ORDER BY x) AS INT) AS place, round((x - avg(x) OVER ()) / stddev_samp(x) OVER (), 6) AS sample FROM ({_BALANCES})")
def qq_show(spark: SparkSession, d: str) -> DataFrame:
    """The sample side of the nations' balances; the theoretical quantiles are tested against published ones."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.round(F.sum(F.col("c_acctbal").cast("double")), 2).alias("x"))
    got = normality.qq_show([r.x for r in c.collect()])  # a nation a row
    return spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(got["sample"], 1)], "place int, sample double")


@query()
def test_normality(spark: SparkSession, d: str) -> DataFrame:
    """By priority, whether the nations' mean prices pass as normal."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    means = o.groupBy("o_orderpriority", "c_nationkey").agg(F.avg(F.col("o_totalprice").cast("double")).alias("x"))

    def one(key, pdf):
        return pd.DataFrame({"priority": [key[0]], "normal": [bool(normality.test_normality(pdf["x"]))]})

    return means.groupBy("o_orderpriority").applyInPandas(one, "priority string, normal boolean")


test_normality.__test__ = False

_FLAGS = f"SELECT value > 50 AS high, event_id % 3 = 0 AS third FROM ({HOLED})"


@query(f"""SELECT variable, CAST(count(x) AS BIGINT) AS n, CAST(count(*) - count(x) AS BIGINT) AS missing, round(100.0 * (count(*) - count(x)) / count(*), 2) AS missing_pct,
 round(100.0 * count(*) FILTER (WHERE x) / count(x), 2) AS true_pct, round(100.0 * count(*) FILTER (WHERE NOT x) / count(x), 2) AS false_pct
 FROM (SELECT 'high' AS variable, high AS x FROM ({_FLAGS}) UNION ALL SELECT 'third', third FROM ({_FLAGS})) GROUP BY 1""")
def data_overview_logical(spark: SparkSession, d: str) -> DataFrame:
    return overview.logical_profile(holed(spark, d).select((F.col("value") > 50).alias("high"), (F.col("event_id") % 3 == 0).alias("third")))


# Columns that each have one fault, and rows without any value.
_FAULTY = """SELECT CASE WHEN event_id % 50 = 49 THEN NULL ELSE 1 END AS same, CASE WHEN event_id % 50 = 49 THEN NULL WHEN event_id % 20 = 0 THEN -1.0::DOUBLE ELSE CAST(event_id AS DOUBLE) END AS sign,
 CASE WHEN event_id % 50 = 49 THEN NULL WHEN event_id % 10 = 0 THEN DATE '1890-01-01' WHEN event_id % 10 = 1 THEN DATE '2090-01-01' ELSE DATE '2020-05-05' END AS day FROM events"""


@query(f"""WITH f AS ({_FAULTY}) SELECT 'near_zero_variance' AS issue, 'same' AS variable, 'distinct' AS metric, 1.0::DOUBLE AS value
 UNION ALL SELECT 'negative_in_positive', 'sign', 'negative', CAST(count(*) FILTER (WHERE sign < 0) AS DOUBLE) FROM f
 UNION ALL SELECT 'suspicious_dates', 'day', 'suspicious', CAST(count(*) FILTER (WHERE year(day) < 1910 OR year(day) > 2030) AS DOUBLE) FROM f
 UNION ALL SELECT 'empty_columns', 'hollow', 'total', 0.0::DOUBLE
 UNION ALL SELECT 'empty_rows', '*', 'n', CAST(count(*) FILTER (WHERE same IS NULL) AS DOUBLE) FROM f
 UNION ALL SELECT 'missing_values', v, 'missing_pct', p FROM (SELECT unnest(['same', 'sign', 'day']) AS v, round(100.0 * count(*) FILTER (WHERE same IS NULL) / count(*), 2) AS p FROM f GROUP BY 1)
 UNION ALL SELECT 'missing_values', 'hollow', 'missing_pct', 100.0::DOUBLE
 UNION ALL SELECT 'duplicate_rows', '*', 'n', CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM f)) AS DOUBLE) FROM f""")
def data_overview_each_issue(spark: SparkSession, d: str) -> DataFrame:
    return overview.quality_issues(_faulty(spark, d), "iqr", 3.0, current_year=2030).where("issue <> 'outliers'")


def _faulty(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    full = k % 50 != 49
    day = F.when(k % 10 == 0, "1890-01-01").when(k % 10 == 1, "2090-01-01").otherwise("2020-05-05").cast("date")
    sign = F.when(k % 20 == 0, -1.0).otherwise(k.cast("double"))
    return table(spark, d, "events").select(F.when(full, F.lit(1)).alias("same"), F.when(full, sign).alias("sign"), F.when(full, day).alias("day"), F.lit(None).cast("double").alias("hollow"))


@query(f"WITH f AS ({_FAULTY}) SELECT CAST(count(*) AS BIGINT) AS n_rows, 4 AS n_columns, 3 AS n_numeric, 0 AS n_character, 0 AS n_logical, 1 AS n_date, round(100.0 * (count(*) + 3 * count(*) FILTER (WHERE same IS NULL)) / (4 * count(*)), 2) AS missing_pct FROM f")
def data_overview_overall(spark: SparkSession, d: str) -> DataFrame:
    return overview.overall(_faulty(spark, d))


@query("SELECT * FROM (VALUES ('hollow', 'leave the variable out: more than half of it is missing'), ('same', 'consider imputation'), ('sign', 'consider imputation'), ('day', 'consider imputation')) t(variable, recommendation)")
def data_overview_missing_advice(spark: SparkSession, d: str) -> DataFrame:
    return overview.data_overview(_faulty(spark, d), outlier_threshold=3.0, current_year=2030).recommendations.where("issue = 'missing_values'").select("variable", "recommendation")


_SPELT = """SELECT CASE WHEN event_id % 40 = 0 THEN 'Yes' WHEN event_id % 40 = 1 THEN 'yes' WHEN event_id % 40 = 2 THEN 'no' ELSE CAST(event_id % 40 AS VARCHAR) END AS code,
 CASE WHEN event_id % 20 = 0 THEN -(event_id % 100) - 1.5::DOUBLE ELSE CAST(event_id AS DOUBLE) END AS sign,
 CASE WHEN event_id % 10 = 0 THEN DATE '1890-01-01' ELSE DATE '2020-05-05' END AS day FROM events"""


@query(f"""WITH f AS ({_SPELT}), v AS (
 SELECT DISTINCT 'numeric_as_character' AS issue, 'code' AS variable, CASE WHEN regexp_full_match(code, '[0-9]+') THEN 'convertible' ELSE 'problematic' END AS kind, code AS value FROM f
 UNION SELECT 'negative_in_positive', 'sign', 'negative', CAST(sign AS VARCHAR) FROM f WHERE sign < 0
 UNION SELECT 'suspicious_dates', 'day', 'suspicious', CAST(day AS VARCHAR) FROM f WHERE year(day) < 1910),
r AS (SELECT *, row_number() OVER (PARTITION BY issue, variable, kind ORDER BY value) AS r FROM v)
SELECT issue, variable, kind, string_agg(value, '|' ORDER BY value) AS examples FROM r WHERE r <= 3 GROUP BY 1, 2, 3
UNION ALL SELECT 'case_issues', 'code', 'yes', 'Yes|yes'""")
def data_overview_examples(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    code = F.when(k % 40 == 0, "Yes").when(k % 40 == 1, "yes").when(k % 40 == 2, "no").otherwise((k % 40).cast("string"))
    sign = F.when(k % 20 == 0, -(k % 100) - 1.5).otherwise(k.cast("double"))
    day = F.when(k % 10 == 0, "1890-01-01").otherwise("2020-05-05").cast("date")
    found = overview.issue_examples(table(spark, d, "events").select(code.alias("code"), sign.alias("sign"), day.alias("day")), current_year=2030)
    return found.withColumn("examples", F.array_join("examples", "|"))


@query(f"""WITH {cohort._VISIT}, {cohort._LAB} SELECT vid FROM visit WHERE pid IN (SELECT pid FROM visit GROUP BY pid HAVING bool_or(o_totalprice > 300000))
 AND pid IN (SELECT pid FROM lab GROUP BY pid HAVING sum(l_quantity) > 900)""")
def screen_by_text(spark: SparkSession, d: str) -> DataFrame:
    tables, _ = cohort._db(spark, d)
    return cohort._visits(spark, d, parse_rule("any(o_totalprice > 300000) and sum(l_quantity) > 900", tables))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def result_table_sink(spark: SparkSession, d: str) -> DataFrame:
    """Nations written as a result table and read back."""
    root = files.shared_root(spark)
    path = f"{root}/result-{uuid.uuid4().hex}"
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    files.write_table(n, path)
    return spark.read.option("header", True).schema(n.schema).csv(path)
