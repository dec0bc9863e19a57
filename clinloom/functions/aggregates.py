"""Aggregates and windows that treat nulls as missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def na_max(x: Column, na_rm: bool = True) -> Column:
    return F.max(x) if na_rm else F.when(F.count_if(x.isNull()) == 0, F.max(x))


def na_min(x: Column, na_rm: bool = True) -> Column:
    return F.min(x) if na_rm else F.when(F.count_if(x.isNull()) == 0, F.min(x))


def get_valid(x: Column, order: Column, mode: str = "first", disjoint: bool = False) -> Column:
    """The first, middle (lower) or last value that is not null.

    disjoint: the last needs two values, the middle three. The middle collects a group's values.
    """
    key, n = F.when(x.isNotNull(), order), F.count(x)
    if mode == "first":
        return F.min_by(x, key)
    if mode == "last":
        got = F.max_by(x, key)
        return F.when(n > 1, got) if disjoint else got
    if mode != "mid":
        raise ValueError("mode must be first, mid or last")
    listed = F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(order.alias("o"), x.alias("x")))))
    got = F.try_element_at(listed, F.ceil(F.size(listed) / 2).cast("int"))["x"]
    return F.when(n > 2, got) if disjoint else got


def first_mode(df: DataFrame, keys: list[str], x: str, order: str, out: str = "mode") -> DataFrame:
    """By group the most frequent value, the least of ties; if all values differ or there is one only, the first."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("_n"), F.min(order).alias("_o"))
    g = counts.groupBy(*keys).agg(
        F.max("_n").alias("_top"),
        F.count("*").alias("_d"),
        F.min_by(x, "_o").alias("_first"),
        F.min(F.struct((-F.col("_n")).alias("k"), F.col(x).alias("v"))).alias("_best"),
    )
    value = F.when((F.col("_top") == 1) | (F.col("_d") == 1), F.col("_first")).otherwise(F.col("_best.v"))
    groups = df.select(*keys).distinct()
    got = g.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], value.alias(out))
    cond = [groups[k].eqNullSafe(got[f"_k{i}"]) for i, k in enumerate(keys)]
    return groups.join(got, cond, "left").select(*keys, out)


def sample_values(df: DataFrame, keys: list[str], x: str, n_samples: int = 10, unique_only: bool = False, collapse: str = "\n", out: str = "samples") -> DataFrame:
    """By group (keys..., out) up to n values that are not null, those of the least md5 of their text, joined; the same for the same data.

    Equal values are counted where they lie, and no task passes on more than n values of a group. A value that comes
    several times is shown as often, unless unique_only. A group without values has an empty text.
    """
    v = F.col(x).cast("string")
    counts = df.where(F.col(x).isNotNull()).groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], v.alias("_v")).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy(F.md5(F.col("_v").cast("binary")), "_v")
    first = counts.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n_samples)
    times = F.lit(1) if unique_only else F.least("_n", F.lit(n_samples)).cast("int")
    listed = first.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.array_sort(F.collect_list(F.struct("_r", F.array_repeat("_v", times).alias("v")))).alias("_l"))
    listed = listed.withColumn(out, F.array_join(F.slice(F.flatten(F.transform("_l", lambda s: s["v"])), 1, n_samples), collapse)).drop("_l")
    groups = df.select(*keys).distinct()
    return groups.join(listed, [groups[k].eqNullSafe(listed[f"_k{i}"]) for i, k in enumerate(keys)], "left").select(*keys, F.coalesce(out, F.lit("")).alias(out))


def indicate_duplicates(df: DataFrame, columns: list[str] | None = None, out: str = "duplicated") -> DataFrame:
    """Flags every member of a group of equal rows; null equals null.

    Counts are joined back, so one very frequent row is never gathered in one window.
    """
    columns = columns or df.columns
    counts = df.groupBy(*columns).agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    counts = counts.select(*[F.col(c).alias(f"_d{i}") for i, c in enumerate(columns)], F.lit(True).alias(out))
    cond = [df[c].eqNullSafe(counts[f"_d{i}"]) for i, c in enumerate(columns)]
    return df.join(counts, cond, "left").select(*df.columns, F.coalesce(out, F.lit(False)).alias(out))


def fill_with_last(x: str, order: str, partition: list[str]) -> Column:
    """The last value that is not null, carried forward."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last(x, ignorenulls=True).over(w)
