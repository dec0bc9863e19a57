"""Exclusion waterfalls, non-numeric values, missing rates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinloom.functions.numbers import as_numeric


def exclusion_count(df: DataFrame, criteria: dict[str, Column | str], na_exclude: bool = True) -> DataFrame:
    """(ord, Criteria, N): rows at first, rows each criterion removes of those still there, rows left.

    One pass: every row counts for the first criterion that holds for it. A null criterion
    excludes unless na_exclude is false.
    """
    if not criteria:
        raise ValueError("no criteria")
    first = F.lit(0)
    for i, (_, c) in reversed(list(enumerate(criteria.items(), 1))):
        c = F.expr(c) if isinstance(c, str) else c
        first = F.when(F.coalesce(c, F.lit(na_exclude)), F.lit(i)).otherwise(first)
    n = len(criteria)
    row = df.select(first.alias("_i")).agg(F.count("*").alias("n"), *[F.count_if(F.col("_i") == i).alias(f"c{i}") for i in range(n + 1)])
    names = ["Initial N", *criteria, "Final N"]
    values = [F.col("n"), *[F.col(f"c{i}") for i in range(1, n + 1)], F.col("c0")]
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(k).alias("Criteria"), v.alias("N")) for i, (k, v) in enumerate(zip(names, values))])
    return row.select(F.explode(rows).alias("r")).select("r.*")


def check_nonnum(df: DataFrame, column: str, order_by: str | None = None, max_count: int | None = None, show_unique: bool = True, return_idx: bool = False) -> DataFrame:
    """Values that are not null and not numbers: (value), or with return_idx (idx, value), in the order first seen."""
    bad = df.where(F.col(column).isNotNull() & as_numeric(F.col(column)).isNull())
    key = F.col(order_by) if order_by else F.col(column)
    if return_idx:
        if not order_by:
            raise ValueError("an index needs order_by")
        out = bad.select(key.alias("idx"), F.col(column).alias("value"))
        return out.orderBy("idx").limit(max_count) if max_count else out
    if show_unique:
        out = bad.groupBy(F.col(column).alias("value")).agg(F.min(key).alias("_o"))
    else:
        out = bad.select(F.col(column).alias("value"), key.alias("_o"))
    return out.orderBy("_o", "value").limit(max_count).select("value") if max_count else out.select("value")


def _side_by_side(rows: DataFrame, subjects: list[str], max_count: int) -> DataFrame:
    """rows (subject, value, o): each subject's values in a column, first seen first."""
    first = rows.groupBy("subject", "value").agg(F.min("o").alias("o"))
    w = Window.partitionBy("subject").orderBy("o", "value")
    ranked = first.withColumn("row", F.row_number().over(w)).where(F.col("row") <= max_count)
    return ranked.groupBy("row").pivot("subject", subjects).agg(F.first("value"))


def df_view_nonnum(df: DataFrame, max_count: int = 20, subject_col: str | None = None, value_col: str | None = None, order_by: str | None = None, subjects: list[str] | None = None) -> DataFrame:
    """Non-numeric values of each text column, or of each subject of a long table, side by side.

    Columns without any are left out: which ones have some takes one job over the distinct
    subjects, unless subjects are given.
    """
    if subject_col:
        rows = df.select(F.col(subject_col).cast("string").alias("subject"), F.col(value_col).alias("value"), (F.col(order_by) if order_by else F.col(value_col)).alias("o"))
    else:
        cols = [c for c, t in df.dtypes if t == "string"]
        key = F.col(order_by).alias("o") if order_by else F.lit(0).alias("o")
        rows = df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("subject"), F.col(c).alias("value")) for c in cols])).alias("e")).select("e.subject", "e.value", "o")
    rows = rows.where(F.col("value").isNotNull() & as_numeric(F.col("value")).isNull())
    if subjects is None:
        have = {r["subject"] for r in rows.select("subject").distinct().collect()}
        subjects = sorted(have) if subject_col else [c for c in df.columns if c in have]
    return _side_by_side(rows, subjects, max_count)


def _missing(df: DataFrame, c: str) -> Column:
    x = F.col(f"`{c}`")
    return x.isNull() | F.isnan(x) if dict(df.dtypes)[c] in ("double", "float") else x.isNull()


def max_missing_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(row, col): the largest share of missing values in a row and in a column."""
    columns = columns or df.columns
    flags = [_missing(df, c).cast("int") for c in columns]
    per_row = reduce(lambda a, b: a + b, flags) / F.lit(float(len(columns)))
    cols = [F.avg(f).alias(f"_m{i}") for i, f in enumerate(flags)]
    out = df.agg(F.max(per_row).alias("row"), *cols)
    top = F.greatest(*[F.col(f"_m{i}") for i in range(len(columns))]) if len(columns) > 1 else F.col("_m0")
    return out.select("row", top.alias("col"))


def filter_rcs_predictors(df: DataFrame, predictors: list[str] | None = None) -> list[str]:
    """Numeric columns with more than five different values; one aggregate."""
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint")
    cols = [c for c, t in df.dtypes if (t in numeric or t.startswith("decimal")) and (predictors is None or c in predictors)]
    if not cols:
        return []
    row = df.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[i] > 5]
