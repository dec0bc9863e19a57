"""Summaries of long records (subject, value, unit), wide pivots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinloom.functions.aggregates import get_valid, sample_values
from clinloom.functions.numbers import as_numeric
from clinloom.operators.quantiles import quantiles as exact_quantiles


def _number(df: DataFrame, c: str) -> Column:
    return as_numeric(F.col(c)) if dict(df.dtypes)[c] == "string" else F.col(c).cast("double")


def unit_view(df: DataFrame, subject_col: str, value_col: str, unit_col: str, quantiles: tuple[float, ...] = (0.025, 0.975), conflicts_only: bool = True) -> DataFrame:
    """By subject and unit: label (null), count, nvalid, mean, sd, median and quantiles; a null unit is a unit.

    conflicts_only keeps subjects of several units.
    """
    v = _number(df, value_col)
    g = df.groupBy(F.col(subject_col).alias("subject"), F.col(unit_col).alias("unit")).agg(F.count("*").alias("count"), F.count(v).alias("nvalid"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))
    q = exact_quantiles(df, {"x": v}, [0.5, *quantiles], [subject_col, unit_col]).toDF("_s", "_u", "_n", "_q")
    g = g.join(q, g["subject"].eqNullSafe(q["_s"]) & g["unit"].eqNullSafe(q["_u"])).drop("_s", "_u", "_n")
    named = [F.col("_q")[0].alias("median"), *[F.col("_q")[i].alias(f"q_{q:g}") for i, q in enumerate(quantiles, 1)]]
    out = g.select("subject", "unit", F.lit(None).cast("string").alias("label"), "count", "nvalid", "mean", "sd", *named)
    if not conflicts_only:
        return out
    units = df.groupBy(F.col(subject_col).alias("_s")).agg((F.count_distinct(unit_col) + F.max(F.col(unit_col).isNull().cast("int"))).alias("_n")).where(F.col("_n") > 1)
    return out.join(units, out["subject"].eqNullSafe(units["_s"]), "left_semi")


def subject_view(df: DataFrame, subject_col: str, info_cols: list[str], value_col: str | None = None, info_n_samples: int = 10, info_collapse: str = "\n", info_unique: bool = False) -> DataFrame:
    """By subject: target_subject (null), count, for a numeric value nvalid, mean, sd and median, and samples of info columns."""
    number = bool(value_col) and dict(df.dtypes)[value_col] != "string"
    aggs = [F.first(F.lit(None).cast("string")).alias("target_subject"), F.count("*").alias("count")]
    named = df.withColumn("_subject", F.col(subject_col))
    if number:
        v = F.col(value_col).cast("double")
        aggs += [F.count(v).alias("nvalid"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd")]
    out = df.groupBy(F.col(subject_col).alias("subject")).agg(*aggs)
    if number:
        q = exact_quantiles(df, {"v": v}, [0.5], [subject_col]).toDF("_s", "_n", "_q")
        out = out.join(q, out["subject"].eqNullSafe(q["_s"])).withColumn("median", F.col("_q")[0]).drop("_s", "_n", "_q")
    for c in info_cols:
        one = sample_values(named, ["_subject"], c, info_n_samples, info_unique, info_collapse).toDF("_s", c)
        out = out.join(one, out["subject"].eqNullSafe(one["_s"])).drop("_s")
    return out


def to_wide(df: DataFrame, keys: list[str], item_col: str, value_col: str, items: list[str] | None = None, order_by: str | None = None, agg: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row a key, one column an item. items fixes which and their order; items never seen are null.

    Without agg the first value by order_by that is not null. Without items, these are found by
    one job, in the order of the first key that has them.
    """
    if items is None:
        seen = df.where(F.col(item_col).isNotNull()).groupBy(item_col).agg(F.min(F.struct(*keys)).alias("_k")).orderBy("_k", item_col)
        items = [r[item_col] for r in seen.collect()]
    else:
        df = df.where(F.col(item_col).isin(items))
    if agg is None:
        order = F.col(order_by) if order_by else F.lit(0)
        agg = lambda x: get_valid(x, order)
    cols = [agg(F.when(F.col(item_col) == i, F.col(value_col))).alias(str(i)) for i in items]
    return df.groupBy(*keys).agg(*cols)
