"""Reading the test tables, with the missing values and messy texts that they lack injected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The same rows in SQL as holed() gives.
HOLED = "SELECT event_id, user_id, event_type, ts, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events"


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "ts", F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value")).alias("value"))


MESSY = """SELECT event_id, event_type, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN CAST(event_id % 90 AS VARCHAR) || '.5 mg'
 WHEN 2 THEN CAST(event_id % 50 AS VARCHAR) || '-' || CAST(event_id % 50 + 4 AS VARCHAR) WHEN 3 THEN 'NEG' WHEN 4 THEN '<' || CAST(event_id % 11 AS VARCHAR) ELSE CAST(event_id % 17 AS VARCHAR) END AS txt FROM events"""


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    e.createOrReplaceTempView("_clinloom_events")
    return spark.sql(MESSY.replace("VARCHAR", "STRING").replace("FROM events", "FROM _clinloom_events"))


UNITS = "SELECT event_id, event_type, value, CASE event_id % 3 WHEN 0 THEN 'mg' WHEN 1 THEN 'g' ELSE NULL END AS unit FROM events"


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 3
    return e.select("event_id", "event_type", "value", F.when(k == 0, "mg").when(k == 1, "g").alias("unit"))
