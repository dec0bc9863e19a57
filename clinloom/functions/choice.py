"""Conditions, indices and multiple choice as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def na2false(x: Column, numeric: bool = False) -> Column:
    return F.coalesce(x, F.lit(0) if numeric else F.lit(False))


def _each(value, n: int, name: str) -> list:
    values = list(value) if isinstance(value, (list, tuple)) else [value]
    if len(values) not in (1, n):
        raise ValueError(f"{name} must have length 1 or {n}")
    return values * n if len(values) == 1 else values


def calculate_index(*conditions: Column, weight=1, na_replace=0) -> Column:
    """The weighted sum of conditions, truth values or whole parts of numbers; a null adds its na_replace."""
    if not conditions:
        raise ValueError("at least one condition is needed")
    w, na = _each(weight, len(conditions), "weight"), _each(na_replace, len(conditions), "na_replace")
    terms = [F.coalesce(c.cast("int") * F.lit(float(k)), F.lit(float(r))) for c, k, r in zip(conditions, w, na)]
    return reduce(lambda a, b: a + b, terms)


def answer_check(df: DataFrame, key: list[str], multi_column: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Columns X1, X2, ... that tell whether each answer equals its key; null is wrong.

    multi_column: a key such as TFT is spread over as many truth columns as it has letters.
    """
    columns = columns or df.columns
    if not multi_column:
        if len(columns) != len(key):
            raise ValueError("answers and keys differ in number")
        return df.select(*[F.coalesce(F.col(c).cast("string") == F.lit(str(k)), F.lit(False)).alias(f"X{i}") for i, (c, k) in enumerate(zip(columns, key), 1)])
    types = dict(df.dtypes)
    out, at = [], 0
    for i, k in enumerate(key, 1):
        if at >= len(columns):
            raise ValueError("more keys than columns")
        if types[columns[at]] != "boolean":
            out.append(F.coalesce(F.col(columns[at]).cast("string") == F.lit(k), F.lit(False)).alias(f"X{i}"))
            at += 1
            continue
        part = columns[at : at + len(k)]
        if len(part) < len(k) or any(types[c] != "boolean" for c in part):
            raise ValueError(f"key {k} needs {len(k)} truth columns")
        given = F.concat(*[F.when(F.col(c), F.lit("T")).otherwise(F.lit("F")) for c in part])
        known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in part])
        out.append((known & (given == F.lit(k))).alias(f"X{i}"))
        at += len(k)
    if at != len(columns):
        raise ValueError("columns are left over")
    return df.select(*out)


def combine_multichoice(df: DataFrame, groups: dict[str, list[str]], sep: str = ",", remove_cols: bool = True, remove_prefix: bool = True) -> DataFrame:
    """For each named group of truth columns one text column that lists the chosen ones."""
    types = dict(df.dtypes)
    if not all(groups):
        raise ValueError("groups need names")
    for cols in groups.values():
        if bad := [c for c in cols if c not in types]:
            raise ValueError(f"missing columns: {bad}")
        if bad := [c for c in cols if types[c] != "boolean"]:
            raise ValueError(f"not truth values: {bad}")

    def label(name: str, c: str) -> str:
        return c[len(name) :].lstrip("_.") if remove_prefix and c.startswith(name) and c != name else c

    made = {name: F.concat_ws(sep, *[F.when(F.col(c), F.lit(label(name, c))) for c in cols]) for name, cols in groups.items()}
    out = df.withColumns(made)
    gone = {c for cols in groups.values() for c in cols} - set(groups)
    return out.drop(*gone) if remove_cols else out


def split_multichoice(df: DataFrame, quest_cols: list[str], split: str = "", remove_space: bool = True, link: str = "_", remove_cols: bool = True, options: dict[str, list[str]] | None = None, order_by: str | None = None) -> DataFrame:
    """For each option of a multiple-choice column one truth column; null stays null.

    Options come in the order first seen (by order_by, else by text); finding them is one
    aggregate over the distinct options unless `options` gives them.
    """
    out = df
    for c in quest_cols:
        x = F.regexp_replace(F.col(c), r"\s+", "") if remove_space else F.col(c)
        parts = F.split(x, "" if split == "" else (split if len(split) > 1 else "\\Q" + split + "\\E"))
        parts = F.filter(parts, lambda p: p != "")
        found = (options or {}).get(c)
        if found is None:
            key = F.col(order_by) if order_by else F.lit(0)
            seen = df.where(F.col(c).isNotNull()).select(key.alias("_k"), F.posexplode(parts).alias("_p", "_o"))
            seen = seen.groupBy("_o").agg(F.min(F.struct("_k", "_p")).alias("_f")).orderBy("_f" if order_by else "_o", "_o")
            found = [r["_o"] for r in seen.select("_o").collect()]
        out = out.withColumns({f"{c}{link}{o}": F.when(F.col(c).isNotNull(), F.array_contains(parts, o)) for o in found})
    return out.drop(*quest_cols) if remove_cols else out
