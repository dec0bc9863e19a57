"""Delimited files in, result tables out."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that executors and driver share, named in spark.checkpoint.dir; where that is unset, a temporary one, but only if all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="clinloom-")


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: what several jobs read is made once."""
    path = f"{shared_root(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def list_files(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = False) -> list[str]:
    """Files of a folder in any store that Spark reads, by a regular expression on their names."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    out, walk = [], fs.listFiles(p, recursive)
    while walk.hasNext():
        f = walk.next().getPath()
        if pattern is None or re.search(pattern, f.getName()):
            out.append(f.toString())
    return sorted(out)


def combine_files(spark: SparkSession, path: str = ".", pattern: str | None = None, recursive: bool = False, add_file_name: bool = False, unique_only: bool = True, reader: Callable[[SparkSession, list[str]], DataFrame] | None = None) -> DataFrame | None:
    """Rows of all files that match, distinct unless unique_only is false; None without files.

    add_file_name puts origin_file first (with underscores until it clashes with no column);
    rows are then distinct within a file. All files are read in one scan, by their header.
    """
    files = list_files(spark, path, pattern, recursive)
    if not files:
        return None
    df = reader(spark, files) if reader else spark.read.option("header", True).option("inferSchema", True).option("enforceSchema", False).csv(files)
    if add_file_name:
        name = "origin_file"
        while name in df.columns:
            name += "_"
        df = df.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias(name), *df.columns)
    return df.dropDuplicates() if unique_only else df


def combine_frames(frames: list[DataFrame], unique_only: bool = True) -> DataFrame:
    out = reduce(DataFrame.unionByName, frames)
    return out.dropDuplicates() if unique_only else out


def write_table(df: DataFrame, path: str, small: bool = True) -> None:
    """A result table as CSV with a header, nulls empty; small ones as one file."""
    (df.coalesce(1) if small else df).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


#: File names that results take by default.
DEFAULT_NAMES = {
    "unit_view": "unit_view.csv",
    "subject_view": "subject_view.csv",
    "baseline": "baseline_by_{strata}.csv",
    "baseline_missing": "baseline_by_{strata}_missing.csv",
    "baseline_pairwise": "baseline_by_{strata}_pairwise.csv",
    "regression_scan": "{type}_regression_scan_{y}.csv",
    "interaction_scan": "{type}_interaction_scan_{y}.csv",
    "basic_results": "table_{type}_{y}_by_{x}.csv",
    "model_compare": "{prefix}_table.csv",
}
