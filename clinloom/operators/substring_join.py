"""Containment join: texts matched with groups of keywords, by pieces of three characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


GRAM = 3


def _pieces(text: Column, size) -> Column:
    """All distinct pieces of that many characters."""
    last = F.length(text) - size + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, size)))).otherwise(F.array().cast("array<string>"))


def _containing(texts: DataFrame, keys: DataFrame, sizes: list[int]) -> DataFrame:
    """(_text, _key): keywords in texts, both folded. Pieces meet by equality; no text is compared with all keywords."""
    size = F.least(F.length("_key"), F.lit(GRAM))
    of_keys = keys.select("_key", F.explode(_pieces(F.col("_key"), size)).alias("_piece"))
    of_texts = texts.select("_text", "_folded", F.explode(F.concat(*[_pieces(F.col("_folded"), F.lit(n)) for n in sizes])).alias("_piece"))
    often = of_texts.join(of_keys.select("_piece").distinct(), "_piece", "left_semi").groupBy("_piece").agg(F.count("*").alias("_n"))
    rarest = of_keys.join(often, "_piece").groupBy("_key").agg(F.min(F.struct("_n", "_piece"))["_piece"].alias("_piece"))
    return of_texts.join(rarest, "_piece").where(F.col("_folded").contains(F.col("_key"))).select("_text", "_key")


def merge_by_substring(data: DataFrame, key_df: DataFrame, search_col: str, key_col: str, value_cols: list[str], case_insensitive: bool = True) -> DataFrame:
    """Each row once for every distinct value_cols of which a keyword is part of its text; else once with nulls.

    Keywords are literal; null and empty ones are dropped. Distinct texts meet a keyword where they
    share its rarest piece of GRAM characters (a shorter keyword is its own piece), and are then searched for it. With no keyword at all the data
    come back unchanged. The search column comes first.
    """
    if missing := [c for c in [search_col] if c not in data.columns] + [c for c in [key_col, *value_cols] if c not in key_df.columns]:
        raise ValueError(f"missing columns: {missing}")
    fold = F.lower if case_insensitive else (lambda c: c)
    keys = key_df.where(F.col(key_col).isNotNull() & (F.col(key_col) != "")).select(fold(F.col(key_col)).alias("_key"), *value_cols).distinct()
    sizes = [r[0] for r in keys.select(F.least(F.length("_key"), F.lit(GRAM)).alias("n")).distinct().collect()]
    if not sizes:
        return data
    texts = data.select(F.col(search_col).alias("_text")).where(F.col("_text").isNotNull()).distinct().withColumn("_folded", fold(F.col("_text")))
    found = _containing(texts, keys.select("_key").distinct(), sorted(sizes)).join(keys, "_key").select("_text", *value_cols).distinct()
    rest = [c for c in data.columns if c != search_col]
    clash = [c for c in value_cols if c in data.columns]
    found = found.select("_text", *[F.col(c).alias(f"{c}.y" if c in clash else c) for c in value_cols])
    out = data.select(*[F.col(c).alias(f"{c}.x" if c in clash else c) for c in [search_col, *rest]])
    return out.join(found, out[f"{search_col}.x" if search_col in clash else search_col] == found["_text"], "left").drop("_text")


def unmake_names(names: list[str], original: list[str]) -> list[str | None]:
    """The original of each syntactic name; unknown ones are None."""
    back: dict[str, str] = {}
    for o in original:
        back.setdefault(make_name(o), o)
    return [back.get(n) for n in names]


def make_name(name: str) -> str:
    import re

    s = re.sub(r"[^\w.]", ".", name)
    if not s or not re.match(r"[A-Za-z]|\.(?!\d)", s):
        s = "X" + s
    return s
