"""Queries of the cleaning scalars, aggregates and reshaping operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinloom.functions import aggregates as A
from clinloom.functions import choice, dates, numbers, text
from clinloom.operators import cut, outliers, quality, scan, units, views
from clinloom.plans.tables import HOLED, MESSY, UNITS, holed, messy, table
from clinloom.plans.tables import units as unit_rows

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT event_id, coalesce(value > 50, false) AS high, coalesce(value, 0) AS v FROM ({HOLED})")
def na2false(spark: SparkSession, d: str) -> DataFrame:
    return holed(spark, d).select("event_id", choice.na2false(F.col("value") > 50).alias("high"), choice.na2false(F.col("value"), numeric=True).alias("v"))


@query("""SELECT o_orderkey, CASE WHEN s = 'P' THEN 'open' WHEN s IS NULL THEN 'none' ELSE s END AS status FROM
 (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'P' WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders)""")
def replace_elements(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("o_orderstatus") == "O", "O").when(F.col("o_orderkey") % 5 == 0, None).otherwise(F.col("o_orderstatus"))
    return table(spark, d, "orders").select("o_orderkey", text.replace_elements(s, ["O", "P", None], ["P", "open", "none"]).alias("status"))


@query("SELECT p_partkey, replace(replace(p_type, 'COPPER', 'cu'), 'A', 'a') AS t FROM part")
def str_match_replace(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.str_match_replace(F.col("p_type"), ["A", "COPPER"], ["a", "cu"]).alias("t"))


@query("""SELECT page_id, CASE WHEN url IS NULL THEN NULL WHEN NOT regexp_matches(url, 'com|org|net') THEN ''
 ELSE regexp_extract(url, '^((?s:.*?)(?:com|org|net))', 1) END AS first_part,
 CASE WHEN url IS NULL THEN NULL WHEN NOT regexp_matches(url, 'com|org|net') THEN '' ELSE regexp_extract(url, '^(?s:.*)(?:com|org|net)((?s:.*))$', 1) END AS rest FROM pages""")
def keep_by_keyword(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", text.keep_by_keyword(u, "com|org|net").alias("first_part"), text.keep_by_keyword(u, "com|org|net", "last", "end", include_keyword=False).alias("rest"))


_FW = "translate('<' || CAST(event_id AS VARCHAR) || '..5 ', '0123456789', '０１２３４５６７８９')"


@query(f"""SELECT event_id, nullif(replace(regexp_replace(translate({_FW}, '０１２３４５６７８９', '0123456789'), '\\.+', '.', 'g'), ' ', ''), '') AS v,
 nullif(replace(replace(regexp_replace(translate({_FW}, '０１２３４５６７８９', '0123456789'), '\\.+', '.', 'g'), ' ', ''), '<', ''), '') AS w FROM events""")
def value_initial_cleaning(spark: SparkSession, d: str) -> DataFrame:
    x = F.translate(F.concat(F.lit("<"), F.col("event_id").cast("string"), F.lit("..5 ")), "0123456789", "０１２３４５６７８９")
    return table(spark, d, "events").select("event_id", text.value_initial_cleaning(x).alias("v"), text.value_initial_cleaning(x, remove_inequal=True).alias("w"))


@query("SELECT event_id, nullif(trim(regexp_replace('  ' || event_type || '  ' || CAST(event_id % 3 AS VARCHAR) || ' ', '\\s+', ' ', 'g')), '') AS c FROM events")
def char_initial_cleaning(spark: SparkSession, d: str) -> DataFrame:
    x = F.concat(F.lit("　 "), F.col("event_type"), F.lit(" \t"), (F.col("event_id") % 3).cast("string"), F.lit("\n"))
    return table(spark, d, "events").select("event_id", text.char_initial_cleaning(x).alias("c"))


_PAT = "-?\\d+\\.?\\d*|-?\\.\\d+"


@query(f"""SELECT event_id, TRY_CAST(regexp_extract_all(txt, '{_PAT}')[1] AS DOUBLE) AS first_num,
 CASE WHEN len(regexp_extract_all(txt, '{_PAT}')) = 1 THEN TRY_CAST(regexp_extract_all(txt, '{_PAT}')[1] AS DOUBLE) END AS only_num FROM ({MESSY})""")
def extract_num_first(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("txt")
    return messy(spark, d).select("event_id", numbers.extract_num(x).alias("first_num"), numbers.extract_num(x, multimatch2na=True).alias("only_num"))


@query("""SELECT event_id, CASE len(m) WHEN 1 THEN CAST(m[1] AS DOUBLE) WHEN 2 THEN (CAST(m[1] AS DOUBLE) + CAST(m[2] AS DOUBLE)) / 2 END AS num
 FROM (SELECT event_id, regexp_extract_all(txt, '\\d+\\.?\\d*|\\.\\d+') AS m FROM (""" + MESSY + "))")
def extract_num_range(spark: SparkSession, d: str) -> DataFrame:
    return messy(spark, d).select("event_id", numbers.extract_num(F.col("txt"), "range", allow_neg=False).alias("num"))


@query(f"""WITH m AS (SELECT event_id, txt, TRY_CAST(regexp_extract_all(txt, '{_PAT}')[1] AS DOUBLE) AS n FROM ({MESSY})),
 q AS (SELECT quantile_cont(n, 0.95) AS top FROM m)
 SELECT event_id, CASE WHEN txt LIKE 'NEG%' THEN 0 WHEN txt LIKE '<%' THEN top ELSE n END AS num FROM m, q""")
def extract_num_max_quantile(spark: SparkSession, d: str) -> DataFrame:
    return numbers.extract_num_column(messy(spark, d), "txt", "num", zero_regexp="^NEG", max_regexp="^<").select("event_id", "num")


@query(f"SELECT DISTINCT txt AS value FROM ({MESSY}) WHERE txt IS NOT NULL AND NOT regexp_full_match(txt, '\\d+(\\.\\d*)?')")
def check_nonnum(spark: SparkSession, d: str) -> DataFrame:
    return quality.check_nonnum(messy(spark, d), "txt", order_by="event_id")


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(f"""WITH f AS (SELECT event_type, txt, min(event_id) AS o FROM ({MESSY}) WHERE txt IS NOT NULL AND NOT regexp_full_match(txt, '\\d+(\\.\\d*)?') GROUP BY 1, 2),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY event_type ORDER BY o, txt) AS INT) AS row FROM f)
 SELECT row, {', '.join(f"max(CASE WHEN event_type = '{t}' THEN txt END) AS {t}" for t in _TYPES)} FROM r WHERE row <= 20 GROUP BY row""")
def df_view_nonnum(spark: SparkSession, d: str) -> DataFrame:
    return quality.df_view_nonnum(messy(spark, d), subject_col="event_type", value_col="txt", order_by="event_id", subjects=_TYPES)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders""")
def to_date(spark: SparkSession, d: str) -> DataFrame:
    day, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 6
    serial = F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string")
    x = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "yyyy/M/d")).when(k == 2, F.date_format(day, "yyyyMMdd")).when(k == 3, F.concat(F.date_format(day, "yyyy.MM.dd"), F.lit(" 10:00"))).when(k == 4, serial).otherwise(F.lit("not a date"))
    return table(spark, d, "orders").select("o_orderkey", dates.to_date(x).cast("string").alias("day"))


@query("""SELECT event_id, CAST(coalesce(CAST(value > 50 AS INT) * 2.0, 0.5) + coalesce(CAST(event_type = 'click' AS INT) * 3.0, 0) AS DOUBLE) AS idx FROM (""" + HOLED + ")")
def calculate_index(spark: SparkSession, d: str) -> DataFrame:
    c = choice.calculate_index(F.col("value") > 50, F.col("event_type") == "click", weight=[2, 3], na_replace=[0.5, 0])
    return holed(spark, d).select("event_id", c.alias("idx"))


@query(f"""WITH c AS (SELECT CASE WHEN coalesce(value < 20, true) THEN 1 WHEN event_type = 'error' THEN 2 WHEN user_id % 10 = 0 THEN 3 ELSE 0 END AS i FROM ({HOLED}))
 SELECT ord, "Criteria", "N" FROM (SELECT 0 AS ord, 'Initial N' AS "Criteria", count(*) AS "N" FROM c
 UNION ALL SELECT 1, 'low value', count(*) FILTER (WHERE i = 1) FROM c UNION ALL SELECT 2, 'errors', count(*) FILTER (WHERE i = 2) FROM c
 UNION ALL SELECT 3, 'testers', count(*) FILTER (WHERE i = 3) FROM c UNION ALL SELECT 4, 'Final N', count(*) FILTER (WHERE i = 0) FROM c)""")
def exclusion_count(spark: SparkSession, d: str) -> DataFrame:
    return quality.exclusion_count(holed(spark, d), {"low value": "value < 20", "errors": "event_type = 'error'", "testers": "user_id % 10 = 0"})


@query("""SELECT role = 'user' AS "X1", (turn % 2 = 0) AND NOT (conv_id % 2 = 0) AS "X2" FROM conversations""")
def answer_check(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("role", (F.col("turn") % 2 == 0).alias("a"), (F.col("conv_id") % 2 == 0).alias("b"))
    return choice.answer_check(c, ["user", "TF"], multi_column=True)


_FLAGS = {"q_a": "o_totalprice > 100000", "q_b": "o_orderstatus = 'O'", "q_c": "o_orderkey % 3 = 0"}


@query("""SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice > 100000 THEN 'a' END, CASE WHEN o_orderstatus = 'O' THEN 'b' END, CASE WHEN o_orderkey % 3 = 0 THEN 'c' END) AS q FROM orders""")
def combine_multichoice(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", *[F.expr(v).alias(k) for k, v in _FLAGS.items()])
    return choice.combine_multichoice(o, {"q": list(_FLAGS)})


_LETTERS = sorted(set("AUTOMOBILEBUILDINGFURNITUREMACHINERYHOUSEHOLD"))


@query(f"SELECT c_custkey, {', '.join(f"contains(c_mktsegment, '{x}') AS q_{x}" for x in _LETTERS)} FROM customer")
def split_multichoice(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("q"))
    return choice.split_multichoice(c, ["q"], options={"q": _LETTERS})


@query("""SELECT event_id, CASE WHEN p IS NULL THEN '' WHEN p < 0.001 THEN '<0.001' ELSE printf('%.3f', p) END AS shown FROM
 (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE (event_id % 977 + 0.25) / 9770 END AS p FROM events)""")
def format_pval(spark: SparkSession, d: str) -> DataFrame:
    p = F.when(F.col("event_id") % 9 == 0, None).otherwise((F.col("event_id") % 977 + F.lit(0.25)) / 9770)
    return table(spark, d, "events").select("event_id", numbers.format_pval(p).alias("shown"))


@query(f"SELECT user_id, max(value) AS top, min(value) AS low, CASE WHEN count(*) = count(value) THEN max(value) END AS strict FROM ({HOLED}) GROUP BY user_id")
def na_max_min(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return holed(spark, d).groupBy("user_id").agg(A.na_max(v).alias("top"), A.na_min(v).alias("low"), A.na_max(v, na_rm=False).alias("strict"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(ts) AS o FROM events WHERE event_id % 7 <> 0 GROUP BY 1, 2),
 g AS (SELECT user_id, max(n) AS top, count(*) AS k, arg_min(event_type, o) AS f FROM c GROUP BY 1),
 m AS (SELECT c.user_id, min(event_type) AS m FROM c JOIN g ON c.user_id = g.user_id AND c.n = g.top GROUP BY 1)
 SELECT u.user_id, CASE WHEN top = 1 OR k = 1 THEN f ELSE m END AS mode FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN g ON u.user_id = g.user_id LEFT JOIN m ON u.user_id = m.user_id""")
def first_mode(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "ts", F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("event_type"))
    return A.first_mode(e, ["user_id"], "event_type", "ts")


@query(f"""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ({HOLED}) WHERE value IS NOT NULL),
 g AS (SELECT user_id, max(CASE WHEN i = 1 THEN value END) AS first, max(CASE WHEN i = (n + 1) // 2 THEN value END) AS mid, max(CASE WHEN i = n THEN value END) AS last FROM r GROUP BY 1)
 SELECT u.user_id, first, mid, last FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN g ON u.user_id = g.user_id""")
def get_valid(spark: SparkSession, d: str) -> DataFrame:
    v, o = F.col("value"), F.col("ts")
    return holed(spark, d).groupBy("user_id").agg(*[A.get_valid(v, o, m).alias(m) for m in ("first", "mid", "last")])


@query("""WITH v AS (SELECT DISTINCT event_type, CAST(user_id AS VARCHAR) AS v FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5(v), v) AS k FROM v)
 SELECT event_type, string_agg(v, chr(10) ORDER BY k) AS samples FROM r WHERE k <= 10 GROUP BY 1""")
def get_samples(spark: SparkSession, d: str) -> DataFrame:
    return A.sample_values(table(spark, d, "events"), ["event_type"], "user_id", 10, unique_only=True)


@query("SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS duplicated FROM lineitem")
def indicate_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return A.indicate_duplicates(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"))


@query(f"SELECT event_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM ({HOLED})")
def fill_with_last(spark: SparkSession, d: str) -> DataFrame:
    return scan.last_valid(holed(spark, d), ["user_id"], "ts", "value", "filled").select("event_id", "filled")


@query(f"SELECT max(CAST(value IS NULL AS INT)) / 5.0::DOUBLE AS row, avg(CAST(value IS NULL AS INT)) AS col FROM ({HOLED})")
def max_missing_rates(spark: SparkSession, d: str) -> DataFrame:
    return quality.max_missing_rates(holed(spark, d))


@query(f"""SELECT event_type AS subject, unit, CAST(NULL AS VARCHAR) AS label, count(*) AS count, count(value) AS nvalid, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd,
 round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.025), 6) AS "q_0.025", round(quantile_cont(value, 0.975), 6) AS "q_0.975" FROM ({UNITS}) GROUP BY 1, 2""")
def unit_view(spark: SparkSession, d: str) -> DataFrame:
    out = views.unit_view(unit_rows(spark, d), "event_type", "value", "unit")
    return out.withColumns({c: F.round(f"`{c}`", 6) for c in ("mean", "sd", "median", "q_0.025", "q_0.975")})


@query("SELECT event_type AS subject, CAST(NULL AS VARCHAR) AS target_subject, count(*) AS count, count(value) AS nvalid, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, quantile_cont(value, 0.5) AS median FROM events GROUP BY 1")
def subject_view(spark: SparkSession, d: str) -> DataFrame:
    out = views.subject_view(table(spark, d, "events"), "event_type", ["props"], "value")
    return out.drop("props").withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


@query(f"""SELECT event_id, event_type, CASE WHEN event_type = 'error' AND unit = 'g' THEN NULL WHEN event_type = 'click' AND unit = 'g' THEN value * 1000 WHEN event_type = 'click' AND unit IS NULL THEN value * 2 ELSE value END AS value,
 CASE WHEN event_type IN ('click', 'error') THEN 'mg' WHEN event_type = 'view' THEN 'mg' ELSE unit END AS unit FROM ({UNITS})""")
def unit_standardize(spark: SparkSession, d: str) -> DataFrame:
    rules = [units.UnitRule("click", "mg", {"g": 1000.0, None: 2.0}), units.UnitRule("error", "mg", {}, ("g",)), units.UnitRule("view", None, {"g": 1.0})]
    return units.unit_standardize(unit_rows(spark, d), "event_type", "value", "unit", rules, order_by="event_id")


@query(f"SELECT user_id, max(CASE WHEN event_type = 'view' THEN value END) AS view, max(CASE WHEN event_type = 'click' THEN value END) AS click, CAST(NULL AS DOUBLE) AS absent FROM ({HOLED}) WHERE event_type IN ('view', 'click') GROUP BY 1")
def to_wide_max(spark: SparkSession, d: str) -> DataFrame:
    return views.to_wide(holed(spark, d), ["user_id"], "event_type", "value", items=["view", "click", "absent"], agg=F.max)


@query(f"SELECT user_id, {', '.join(f"arg_min(value, ts) FILTER (WHERE event_type = '{t}' AND value IS NOT NULL) AS {t}" for t in _TYPES)} FROM ({HOLED}) GROUP BY 1")
def to_wide_first(spark: SparkSession, d: str) -> DataFrame:
    return views.to_wide(holed(spark, d), ["user_id"], "event_type", "value", items=_TYPES, order_by="ts")


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'Low' WHEN p_size < 30 THEN 'Medium' ELSE 'High' END AS size FROM part")
def cut_by_breaks(spark: SparkSession, d: str) -> DataFrame:
    return cut.cut_by(table(spark, d, "part"), "p_size", [10, 30], "size", label_type="LMH").select("p_partkey", "size")


@query("WITH q AS (SELECT quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.75) AS b FROM part) SELECT p_partkey, CASE WHEN p_retailprice < a THEN 'c' WHEN p_retailprice < b THEN 'm' ELSE 'e' END AS price FROM part, q")
def cut_by_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return cut.cut_by(table(spark, d, "part"), "p_retailprice", [0.25, 0.75], "price", breaks_as_quantiles=True, labels=["c", "m", "e"]).select("p_partkey", "price")


@query("WITH q AS (SELECT o_orderpriority AS g, quantile_cont(o_totalprice, 0.5) AS m FROM orders GROUP BY 1) SELECT o_orderkey, CASE WHEN o_totalprice < m THEN 'Low' ELSE 'High' END AS band FROM orders JOIN q ON o_orderpriority = g")
def cut_by_group(spark: SparkSession, d: str) -> DataFrame:
    return cut.cut_by(table(spark, d, "orders"), "o_totalprice", [0.5], "band", breaks_as_quantiles=True, group="o_orderpriority").select("o_orderkey", "band")


@query(f"""WITH a AS (SELECT event_type, quantile_cont(value, 0.5) AS m FROM ({HOLED}) GROUP BY 1), b AS (SELECT h.*, m FROM ({HOLED}) h JOIN a USING (event_type)),
 c AS (SELECT event_type, quantile_cont(abs(value - m), 0.5) AS w FROM b GROUP BY 1) SELECT event_id, abs(value - m) > 1.0 * 1.4826 * w AS outlier FROM b JOIN c USING (event_type)""")
def mad_outlier(spark: SparkSession, d: str) -> DataFrame:
    return outliers.flag_outliers(holed(spark, d), "value", "mad", 1.0, ["event_type"]).select("event_id", "outlier")


@query("WITH q AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.75) AS b FROM customer) SELECT c_custkey, c_acctbal < a - 0.4 * (b - a) OR c_acctbal > b + 0.4 * (b - a) AS outlier FROM customer, q")
def iqr_outlier(spark: SparkSession, d: str) -> DataFrame:
    return outliers.flag_outliers(table(spark, d, "customer"), "c_acctbal", "iqr", 0.4).select("c_custkey", "outlier")


@query("WITH q AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem) SELECT l_orderkey, l_linenumber, l_extendedprice, abs(l_extendedprice - m) / s > 1.9 AS outlier FROM lineitem, q")
def zscore_outlier(spark: SparkSession, d: str) -> DataFrame:
    return outliers.flag_outliers(table(spark, d, "lineitem"), "l_extendedprice", "zscore", 1.9).select("l_orderkey", "l_linenumber", "l_extendedprice", "outlier")


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1),
 f AS (SELECT event_type, value, value < a - 0.3 * (b - a) OR value > b + 0.3 * (b - a) AS o FROM events JOIN q USING (event_type))
 SELECT event_type, count(*) FILTER (WHERE o) AS outlier_count, round(100.0 * count(*) FILTER (WHERE o) / count(value), 2) AS outlier_pct, min(value) AS min_before, max(value) AS max_before, round(var_samp(value), 6) AS var_before,
 min(value) FILTER (WHERE NOT o) AS min_after, max(value) FILTER (WHERE NOT o) AS max_after, round(var_samp(value) FILTER (WHERE NOT o), 6) AS var_after, 'iqr' AS method, CAST(0.3 AS DOUBLE) AS threshold FROM f GROUP BY 1""")
def detect_outliers(spark: SparkSession, d: str) -> DataFrame:
    out = outliers.detect_outliers(table(spark, d, "events"), "value", "iqr", 0.3, ["event_type"])
    return out.withColumns({"var_before": F.round("var_before", 6), "var_after": F.round("var_after", 6)})
