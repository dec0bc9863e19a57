"""Numbers in text: conversion and extraction as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC = r"^\s*[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?\s*$"
SIGNED = r"-?\d+\.?\d*|-?\.\d+"
UNSIGNED = r"\d+\.?\d*|\.\d+"


def as_numeric(x: Column) -> Column:
    """Text as a double, or null; only plain decimal notation counts."""
    return F.when(x.rlike(NUMERIC), F.trim(x).try_cast("double"))


def _matches(x: Column, allow_neg: bool) -> Column:
    if not allow_neg:
        return F.regexp_extract_all(x, F.lit(f"({UNSIGNED})"), F.lit(1))
    return F.regexp_extract_all(x, F.lit(f"({SIGNED})"), F.lit(1))


def extract_num(x: Column, res_type: str = "first", multimatch2na: bool = False, leq_1: bool = False, allow_neg: bool = True) -> Column:
    """The first number in a cleaned text, or (range) the mean of two; nothing else of the column is looked at.

    first: null if there are several and multimatch2na, or if it exceeds 1 and leq_1.
    range: one number is itself, two give their mean, more give null.
    """
    if res_type not in ("first", "range"):
        raise ValueError("res_type must be 'first' or 'range'")
    found = _matches(x, allow_neg)
    first = F.get(found, F.lit(0)).try_cast("double")
    if res_type == "range":
        second = F.get(found, F.lit(1)).try_cast("double")
        return F.when(F.size(found) == 1, first).when(F.size(found) == 2, (first + second) / 2)
    if multimatch2na:
        first = F.when(F.size(found) == 1, first)
    return F.when(first <= 1, first) if leq_1 else first


def extract_num_column(df: DataFrame, column: str, out: str, *, clean=None, zero_regexp: str | None = None, max_regexp: str | None = None, max_quantile: float = 0.95, fast_path: bool = True, **options) -> DataFrame:
    """extract_num with what needs the whole column.

    fast_path: if every value is a plain number already, these numbers are the result and no
    option applies. Rows that match max_regexp take a quantile of what was extracted; rows
    that match zero_regexp are 0, last of all. One aggregate finds both facts.
    """
    if dict(df.dtypes)[column] != "string":
        return df.withColumn(out, F.col(column))
    text = F.col(column) if clean is None else clean(F.col(column))
    plain, got = as_numeric(text), extract_num(text, **options)
    facts = df.agg(F.count_if(F.col(column).isNotNull() & plain.isNull()).alias("other"), F.percentile(got, F.lit(max_quantile)).alias("top")) if fast_path or max_regexp else None
    if facts is not None:
        row = facts.first()
        if fast_path and row["other"] == 0:
            return df.withColumn(out, plain)
        if max_regexp:
            got = F.when(F.col(column).rlike(max_regexp), F.lit(row["top"])).otherwise(got)
    if zero_regexp:
        got = F.when(F.col(column).rlike(zero_regexp), F.lit(0.0)).otherwise(got)
    return df.withColumn(out, got)


def format_pval(p: Column, text_ahead: str | None = None, nsmall: int = 3, eps: float = 1e-3, na_empty: bool = True) -> Column:
    """A p-value for print: below eps as `<eps`, else with nsmall decimals; null is empty or stays null."""
    low = F.lit(f"<{eps:.{nsmall}f}" if nsmall else f"<{eps:g}")
    shown = F.format_string(f"%.{nsmall}f", p)
    if text_ahead is not None:
        low = F.lit(f"{text_ahead} < {eps:.{nsmall}f}")
        shown = F.concat(F.lit(f"{text_ahead} = "), shown)
    return F.when(p.isNull(), F.lit("") if na_empty else F.lit(None)).when(p < eps, low).otherwise(shown)
