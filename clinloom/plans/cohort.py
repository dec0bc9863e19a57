"""Queries of the joins and of cohort screening.

Patient = customer, visit = order, date = order date, lab = line items of the orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinloom.operators import screening as S
from clinloom.operators.range_join import merge_by_range
from clinloom.operators.substring_join import merge_by_substring
from clinloom.plans.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _stays(spark: SparkSession, d: str) -> DataFrame:
    """A stay of 60 days from every order date, by customer."""
    o = table(spark, d, "orders")
    day = F.col("o_orderdate").cast("date")
    return o.select("o_orderkey", F.col("o_custkey").alias("cust"), day.alias("day_from"), F.date_add(day, 60).alias("day_to"))


def _ships(spark: SparkSession, d: str) -> DataFrame:
    """Ship dates of line items, by customer."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, li.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", "l_partkey", F.col("o_custkey").alias("cust"), F.col("l_shipdate").cast("date").alias("shipped"))


_X = "x AS (SELECT o_orderkey, o_custkey AS cust, CAST(o_orderdate AS DATE) AS day_from, CAST(o_orderdate AS DATE) + 60 AS day_to FROM orders)"
_Y = "y AS (SELECT l_orderkey, l_linenumber, l_partkey, o_custkey AS cust, CAST(l_shipdate AS DATE) AS shipped FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(f"WITH {_X}, {_Y} SELECT o_orderkey, l_orderkey, l_linenumber, l_partkey, CAST(shipped - day_from AS DOUBLE) AS since_start FROM x JOIN y ON x.cust = y.cust AND shipped BETWEEN day_from AND day_to")
def merge_by_range_basic(spark: SparkSession, d: str) -> DataFrame:
    out = merge_by_range(_stays(spark, d), _ships(spark, d), "cust", "day_from", "day_to", "shipped", all_y=False, keep_row_id=False, validate=False)
    return out.select("o_orderkey", "l_orderkey", "l_linenumber", "l_partkey", "since_start")


@query(f"WITH {_X}, {_Y} SELECT o_orderkey, x.cust AS cust, l_orderkey, l_linenumber, l_partkey, CAST(shipped - day_from AS DOUBLE) AS since_start FROM y LEFT JOIN x ON x.cust = y.cust AND shipped BETWEEN day_from AND day_to")
def merge_by_range_keep_unmatched(spark: SparkSession, d: str) -> DataFrame:
    out = merge_by_range(_stays(spark, d), _ships(spark, d), "cust", "day_from", "day_to", "shipped", keep_row_id=False, validate=False)
    return out.select("o_orderkey", "cust", "l_orderkey", "l_linenumber", "l_partkey", "since_start")


def _clip(before: str, after: str, end: str) -> str:
    """The ranges of x, relaxed and clipped to their neighbours."""
    return f"""{_X}, {_Y},
 r AS (SELECT *, epoch(day_from) / 86400 AS s, epoch({end}) / 86400 AS e FROM x),
 b AS (SELECT cust, s, max(e) AS bend FROM r GROUP BY 1, 2),
 p AS (SELECT *, coalesce(max(bend) OVER (PARTITION BY cust ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-infinity'::DOUBLE) AS prev FROM b),
 l AS (SELECT *, least(s, greatest(s - {before}, prev)) AS lft FROM p),
 n AS (SELECT *, coalesce(lead(lft) OVER (PARTITION BY cust ORDER BY s), 'infinity'::DOUBLE) AS nxt FROM l),
 c AS (SELECT r.*, lft AS cs, greatest(r.e, least(r.e + {after}, nxt)) AS ce, NOT (lft > r.s - {before} AND lft < r.s) AS inc_s,
        NOT (nxt < 'infinity'::DOUBLE AND nxt <= r.e + {after} AND greatest(r.e, least(r.e + {after}, nxt)) = nxt) AS inc_e FROM r JOIN n ON r.cust = n.cust AND r.s = n.s)"""


_MATCH = "(v > cs OR (v = cs AND inc_s)) AND (v < ce OR (v = ce AND inc_e))"


@query(f"WITH {_clip('5', '10', 'day_to')} SELECT o_orderkey, l_orderkey, l_linenumber, l_partkey, CAST(v - s AS DOUBLE) AS since_start FROM c JOIN (SELECT *, epoch(shipped) / 86400 AS v FROM y) y ON c.cust = y.cust AND {_MATCH}")
def merge_by_range_relax(spark: SparkSession, d: str) -> DataFrame:
    out = merge_by_range(_stays(spark, d), _ships(spark, d), "cust", "day_from", "day_to", "shipped", range_relax=(5, 10), all_y=False, keep_row_id=False, validate=False)
    return out.select("o_orderkey", "l_orderkey", "l_linenumber", "l_partkey", "since_start")


_INF = "'infinity'::DOUBLE"


@query(f"WITH {_clip('0', _INF, 'day_from')} SELECT o_orderkey, l_orderkey, l_linenumber, l_partkey, CAST(v - s AS DOUBLE) AS since_start FROM c JOIN (SELECT *, epoch(shipped) / 86400 AS v FROM y) y ON c.cust = y.cust AND {_MATCH}")
def merge_by_range_relax_inf(spark: SparkSession, d: str) -> DataFrame:
    out = merge_by_range(_stays(spark, d), _ships(spark, d), "cust", "day_from", None, "shipped", range_relax=(0, float("inf")), all_y=False, keep_row_id=False)
    return out.select("o_orderkey", "l_orderkey", "l_linenumber", "l_partkey", "since_start")


@query("""SELECT a.event_id AS event_id, b.event_id AS click_id, round(epoch(b.ts) - epoch(a.ts), 3) AS since_start
 FROM (SELECT event_id, ts, ts + INTERVAL 30 MINUTE AS t FROM events WHERE event_type = 'purchase') a JOIN (SELECT event_id, ts FROM events WHERE event_type = 'click') b ON b.ts BETWEEN a.ts AND a.t""")
def merge_by_range_no_key(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    x = e.where("event_type = 'purchase'").select("event_id", "ts", (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("until"))
    y = e.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), F.col("ts").alias("at"))
    out = merge_by_range(x, y, [], "ts", "until", "at", all_y=False, keep_row_id=False, validate=False, bin_width=1800.0, digits=3)
    return out.select("event_id", "click_id", "since_start")


_KEYS = [("steel", "metal"), ("Copper", "metal"), ("brass", "metal"), ("red", "colour"), ("blue", "colour"), ("o", "letter"), (None, "none")]


@query("""WITH k(k, kind) AS (VALUES ('steel', 'metal'), ('Copper', 'metal'), ('brass', 'metal'), ('red', 'colour'), ('blue', 'colour'), ('o', 'letter')),
 f AS (SELECT DISTINCT p_name AS n, kind FROM part JOIN k ON contains(lower(p_name), lower(k)))
 SELECT p_name, p_partkey, kind FROM part LEFT JOIN f ON p_name = n""")
def merge_by_substring_kinds(spark: SparkSession, d: str) -> DataFrame:
    keys = spark.createDataFrame(_KEYS, "k string, kind string")
    return merge_by_substring(table(spark, d, "part").select("p_partkey", "p_name"), keys, "p_name", "k", ["kind"])


def _db(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], dict]:
    o = table(spark, d, "orders")
    lab = table(spark, d, "lineitem").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    lab = lab.select(F.col("o_custkey").alias("pid"), F.col("l_orderkey").alias("vid"), "l_linenumber", "l_quantity", F.when(F.col("l_orderkey") % 5 == 0, None).otherwise(F.col("l_discount")).alias("disc"))
    tables = {
        "patient": table(spark, d, "customer").select(F.col("c_custkey").alias("pid"), "c_acctbal"),
        "visit": o.select(F.col("o_custkey").alias("pid"), F.col("o_orderkey").alias("vid"), F.col("o_orderdate").alias("day"), "o_totalprice", "o_orderpriority"),
        "lab": lab,
    }
    return tables, {"patient_id_map": "pid", "visit_id_map": "vid", "date_map": {"visit": "day"}}


_LAB = "lab AS (SELECT o_custkey AS pid, l_orderkey AS vid, l_linenumber, l_quantity, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_discount END AS disc FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_VISIT = "visit AS (SELECT o_custkey AS pid, o_orderkey AS vid, o_orderdate AS day, o_totalprice, o_orderpriority FROM orders)"


def _visits(spark: SparkSession, d: str, rule, **more) -> DataFrame:
    tables, maps = _db(spark, d)
    return S.screen_data_list(tables, rule, **maps, **more).data["visit"].select("vid")


@query(f"WITH {_VISIT} SELECT vid FROM visit WHERE pid IN (SELECT pid FROM visit GROUP BY pid HAVING bool_or(o_orderpriority = '1-URGENT'))")
def screen_any(spark: SparkSession, d: str) -> DataFrame:
    return _visits(spark, d, S.any_("visit", "o_orderpriority = '1-URGENT'"))


@query(f"WITH {_VISIT}, {_LAB} SELECT vid FROM visit WHERE pid IN (SELECT pid FROM lab GROUP BY pid HAVING bool_and(coalesce(disc >= 0 AND l_quantity > 1, false)))")
def screen_all(spark: SparkSession, d: str) -> DataFrame:
    return _visits(spark, d, S.all_("lab", "disc >= 0 AND l_quantity > 1"))


@query(f"WITH {_VISIT}, {_LAB} SELECT vid FROM visit WHERE pid IN (SELECT pid FROM lab GROUP BY pid HAVING avg(disc) > 0.0501)")
def screen_mean(spark: SparkSession, d: str) -> DataFrame:
    return _visits(spark, d, S.agg_("lab", "mean", "disc", na_rm=True) > 0.0501)


@query(f"""WITH {_VISIT}, {_LAB} SELECT vid FROM visit WHERE pid IN (SELECT pid FROM visit GROUP BY pid HAVING bool_or(o_totalprice > 300000))
 AND pid IN (SELECT pid FROM lab GROUP BY pid HAVING sum(l_quantity) > 900) AND pid IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def screen_and(spark: SparkSession, d: str) -> DataFrame:
    return _visits(spark, d, S.any_("visit", "o_totalprice > 300000") & (S.agg_("lab", "sum", "l_quantity") > 900) & S.row_("patient", "c_acctbal > 0"))


@query(f"""WITH {_VISIT}, {_LAB} SELECT vid FROM visit WHERE pid IN (SELECT pid FROM visit GROUP BY pid HAVING bool_and(o_totalprice > 50000))
 OR pid IN (SELECT pid FROM lab GROUP BY pid HAVING count(*) = count(disc) AND max(disc) < 0.1)""")
def screen_or(spark: SparkSession, d: str) -> DataFrame:
    return _visits(spark, d, S.all_("visit", "o_totalprice > 50000") | (S.agg_("lab", "max", "disc") < 0.1))


@query(f"WITH {_LAB} SELECT vid, l_linenumber, l_quantity FROM lab WHERE (pid, vid) IN (SELECT (pid, vid) FROM lab GROUP BY pid, vid HAVING bool_or(l_quantity > 49))")
def screen_visit_level(spark: SparkSession, d: str) -> DataFrame:
    tables, maps = _db(spark, d)
    return S.screen_data_list(tables, S.any_("lab", "l_quantity > 49"), S.VISIT, **maps).data["lab"].select("vid", "l_linenumber", "l_quantity")


_ANCHOR = f"""WITH {_VISIT}, e AS (SELECT pid FROM visit GROUP BY pid HAVING bool_or(o_orderpriority = '1-URGENT')),
 a AS (SELECT pid, min(day) AS d0 FROM visit WHERE pid IN (SELECT pid FROM e) AND o_totalprice > 300000 GROUP BY pid),
 kept AS (SELECT visit.* FROM visit JOIN a ON visit.pid = a.pid WHERE day >= d0)"""


def _anchored(spark: SparkSession, d: str, **more) -> S.ScreenResult:
    tables, maps = _db(spark, d)
    return S.screen_data_list(tables, S.any_("visit", "o_orderpriority = '1-URGENT'"), anchor=S.any_("visit", "o_totalprice > 300000"), **maps, **more)


@query(f"{_ANCHOR} SELECT pid, vid, o_totalprice FROM kept")
def screen_anchor(spark: SparkSession, d: str) -> DataFrame:
    return _anchored(spark, d).data["visit"].select("pid", "vid", "o_totalprice")


@query(f"""WITH {_VISIT}, a AS (SELECT pid, min(vid) AS v0 FROM visit WHERE o_totalprice > 300000 GROUP BY pid)
 SELECT visit.pid AS pid, CAST(vid AS VARCHAR) AS vid FROM visit JOIN a ON visit.pid = a.pid WHERE vid >= v0""")
def screen_anchor_text(spark: SparkSession, d: str) -> DataFrame:
    """Visit ids that are text but hold numbers, from a patient's first dear one on."""
    tables, maps = _db(spark, d)
    tables = {n: t.withColumn("vid", F.col("vid").cast("string")) if "vid" in t.columns else t for n, t in tables.items()}
    always = S.any_("visit", "true")
    return S.screen_data_list(tables, always, anchor=S.any_("visit", "o_totalprice > 300000"), anchor_level=S.VISIT, **maps).data["visit"].select("pid", "vid")


@query(f"{_ANCHOR} SELECT pid, vid FROM kept WHERE pid IN (SELECT pid FROM kept GROUP BY pid HAVING count(DISTINCT vid) >= 5)")
def screen_followup(spark: SparkSession, d: str) -> DataFrame:
    return _anchored(spark, d, followup_min_visits=5).data["visit"].select("pid", "vid")


@query(f"""{_ANCHOR} SELECT patient_id, visit_id, c_acctbal, o_totalprice FROM (SELECT c_custkey AS patient_id, c_acctbal FROM customer WHERE c_custkey IN (SELECT pid FROM a)) p
 FULL JOIN (SELECT pid, vid AS visit_id, o_totalprice FROM kept) v ON patient_id = pid""")
def screen_joined(spark: SparkSession, d: str) -> DataFrame:
    tables, maps = _db(spark, d)
    tables.pop("lab")
    out = S.screen_data_list(tables, S.any_("visit", "o_orderpriority = '1-URGENT'"), anchor=S.any_("visit", "o_totalprice > 300000"), output="joined", **maps).data
    return out.select("patient_id", "visit_id", "c_acctbal", "o_totalprice")


@query(f"""{_ANCHOR} SELECT 'anchor' AS step, 'visit' AS "table", (SELECT count(*) FROM visit WHERE pid IN (SELECT pid FROM e)) AS n_before, (SELECT count(*) FROM kept) AS n_after,
 (SELECT count(*) FROM visit WHERE pid IN (SELECT pid FROM e)) - (SELECT count(*) FROM kept) AS n_removed
 UNION ALL SELECT 'anchor', 'patient', (SELECT count(*) FROM e), (SELECT count(*) FROM a), (SELECT count(*) FROM e) - (SELECT count(*) FROM a)""")
def screen_audit(spark: SparkSession, d: str) -> DataFrame:
    audit = _anchored(spark, d, return_audit=True).audit["anchor_scope"]
    return audit.where("table <> 'lab'")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return screen_anchor(spark, d)
