"""Repair of text in a wrong encoding."""

from __future__ import annotations

import warnings

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CANDIDATES = ("gbk", "gb2312", "latin-1", "utf-8")


def auto_encoding_repair(df: DataFrame, column: str, from_encoding: str = "auto") -> DataFrame:
    """A binary column decoded: valid UTF-8 as such; the rest by the first candidate that decodes all of it cleanly.

    One aggregate finds that candidate; if there is none, invalid values become null, with a warning.
    """
    names = CANDIDATES if from_encoding == "auto" else (from_encoding,)
    bad = df.where(F.col(column).isNotNull() & ~F.is_valid_utf8(F.col(column).cast("string")))

    @F.pandas_udf("array<boolean>")
    def clean(b: pd.Series) -> pd.Series:
        def one(x: bytes, enc: str) -> bool:
            try:
                s = x.decode(enc)
            except UnicodeDecodeError:
                return False
            return "�" not in s and "\x1a" not in s

        return b.map(lambda x: [one(x, e) for e in names])

    facts = bad.select(clean(column).alias("ok")).agg(F.count("*").alias("n"), *[F.bool_and(F.col("ok")[i]).alias(f"e{i}") for i in range(len(names))]).first()
    text = F.col(column).cast("string")
    if not facts["n"]:
        return df.withColumn(column, text)
    chosen = next((e for i, e in enumerate(names) if facts[f"e{i}"]), None)
    warnings.warn(f"{facts['n']} values are not UTF-8; " + (f"read as {chosen}" if chosen else "made null"), stacklevel=2)
    if chosen is None:
        return df.withColumn(column, F.when(F.is_valid_utf8(text), text))

    @F.pandas_udf("string")
    def read(b: pd.Series) -> pd.Series:
        return b.map(lambda x: None if x is None else x.decode(chosen, "replace"))

    return df.withColumn(column, F.when(F.is_valid_utf8(text), text).otherwise(read(column)))
