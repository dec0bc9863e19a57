"""Profile and quality audit of a table in two jobs: one wide aggregate, one value count."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinloom.functions.numbers import as_numeric
from clinloom.operators.outliers import outlier_counts
from clinloom.operators.quantiles import quantiles

NUMERIC = {"double", "float", "int", "bigint", "smallint", "tinyint"}


def variable_types(df: DataFrame) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {"numeric": [], "character": [], "logical": [], "date": [], "other": []}
    for c, t in df.dtypes:
        kind = "numeric" if t in NUMERIC or t.startswith("decimal") else {"string": "character", "boolean": "logical", "date": "date", "timestamp": "date", "timestamp_ntz": "date"}.get(t, "other")
        out[kind].append(c)
    return out


def _union(rows: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rows)


def _unpivot(df: DataFrame, parts: dict[str, dict[str, Column]]) -> DataFrame:
    """One row for each name, with the same metrics, from one wide aggregate."""
    flat = df.agg(*[v.alias(f"{i}|{m}") for i, ms in enumerate(parts.values()) for m, v in ms.items()])
    rows = [F.struct(F.lit(n).alias("variable"), *[F.col(f"`{i}|{m}`").alias(m) for m in ms]) for i, (n, ms) in enumerate(parts.items())]
    return flat.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _gone(df: DataFrame, c: str) -> Column:
    x = F.col(f"`{c}`")
    return x.isNull() | F.isnan(x) if dict(df.dtypes)[c] in ("double", "float") else x.isNull()


def numeric_profile(df: DataFrame, digits: int = 2) -> DataFrame:
    """variable, n, missing, missing_pct, mean, median, min, max, sd."""
    parts = {}
    for c in variable_types(df)["numeric"]:
        x, na = F.col(f"`{c}`").cast("double"), _gone(df, c)
        x = F.when(~na, x)
        parts[c] = {"n": F.count(x), "missing": F.count_if(na), "missing_pct": F.round(100 * F.avg(na.cast("double")), digits), "mean": F.round(F.avg(x), digits), "min": F.round(F.min(x), digits), "max": F.round(F.max(x), digits), "sd": F.round(F.stddev_samp(x), digits)}
    if not parts:
        return _unpivot(df, parts)
    names = list(parts)
    mid = quantiles(df, {str(i): F.col(f"`{c}`").cast("double") for i, c in enumerate(names)}, [0.5])
    mid = mid.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.round(F.col(f"q_{i}")[0], digits).alias("median")) for i, c in enumerate(names)])).alias("r")).select("r.*")
    return _unpivot(df, parts).join(mid, "variable").select("variable", "n", "missing", "missing_pct", "mean", "median", "min", "max", "sd")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, value, n) of several columns in one shuffle."""
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("e")).select("e.*").groupBy("variable", "value").agg(F.count("*").alias("n"))


def character_profile(df: DataFrame, digits: int = 2) -> DataFrame:
    """variable, n, missing, missing_pct, unique, top_value (least of ties), top_freq, top_pct."""
    counts = value_counts(df, variable_types(df)["character"])
    have = F.col("value").isNotNull()
    g = counts.groupBy("variable").agg(
        F.sum(F.when(have, F.col("n"))).alias("n"), F.coalesce(F.sum(F.when(~have, F.col("n"))), F.lit(0)).alias("missing"),
        F.count_if(have).alias("unique"), F.min(F.when(have, F.struct((-F.col("n")).alias("k"), "value"))).alias("top"),
    )
    g = g.withColumn("n", F.coalesce("n", F.lit(0)))
    return g.select("variable", "n", "missing", F.round(100.0 * F.col("missing") / (F.col("n") + F.col("missing")), digits).alias("missing_pct"), "unique", F.col("top.value").alias("top_value"), (-F.col("top.k")).alias("top_freq"), F.round(-100.0 * F.col("top.k") / F.col("n"), digits).alias("top_pct"))


def logical_profile(df: DataFrame, digits: int = 2) -> DataFrame:
    parts = {}
    for c in variable_types(df)["logical"]:
        x = F.col(f"`{c}`")
        parts[c] = {"n": F.count(x), "missing": F.count_if(x.isNull()), "missing_pct": F.round(100 * F.avg(x.isNull().cast("double")), digits), "true_pct": F.round(100 * F.avg(x.cast("double")), digits), "false_pct": F.round(100 * F.avg((~x).cast("double")), digits)}
    return _unpivot(df, parts)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(n): rows beyond the first of each group of equal rows."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n"))


def quality_issues(df: DataFrame, outlier_method: str = "iqr", outlier_threshold: float | None = None, current_year: int | None = None) -> DataFrame:
    """(issue, variable, metric, value): every quality issue found, with its figures.

    current_year: dates beyond it are suspicious; the clock's by default.
    """
    kinds, n_cols = variable_types(df), len(df.columns)
    year = F.lit(current_year) if current_year else F.year(F.current_date())
    rows: list[DataFrame] = []
    wide: dict[str, dict[str, Column]] = {}
    for c in df.columns:
        x, na = F.col(f"`{c}`"), _gone(df, c)
        m = {"total": F.count_if(~na).cast("double"), "missing_pct": F.round(100 * F.avg(na.cast("double")), 2)}
        zero = F.lit(None).cast("double")
        m["convertible"] = F.count_if(as_numeric(x).isNotNull()).cast("double") if c in kinds["character"] else zero
        m["distinct"] = F.count_distinct(F.when(~na, x)).cast("double") if c in kinds["numeric"] + kinds["character"] + kinds["logical"] else zero
        m["negative"] = F.count_if(~na & (x < 0)).cast("double") if c in kinds["numeric"] else zero
        m["binary"] = F.min(F.when(~na, x.isin(0, 1).cast("double"))) if c in kinds["numeric"] else zero
        m["suspicious"] = F.count_if((F.year(x) < 1910) | (F.year(x) > year)).cast("double") if c in kinds["date"] else zero
        m["folded"] = F.count_distinct(F.lower(x)).cast("double") if c in kinds["character"] else zero
        wide[c] = m
    facts = _unpivot(df, wide)
    col = F.col
    rules = [
        ("numeric_as_character", col("convertible") > 0, "convertible"),
        ("missing_values", col("missing_pct") >= 1, "missing_pct"),
        ("near_zero_variance", col("distinct") == 1, "distinct"),
        ("negative_in_positive", (col("negative") > 0) & ((col("total") - col("negative")) / col("total") > 0.9), "negative"),
        ("empty_columns", col("total") == 0, "total"),
        ("suspicious_dates", col("suspicious") > 0, "suspicious"),
        ("low_cardinality", col("binary").isNotNull() & (col("distinct") <= 5) & (col("binary") == 0), "distinct"),
        ("case_issues", col("folded") < col("distinct"), "folded"),
    ]
    # every rule on one pass over the facts
    tried = F.array(*[F.struct(F.lit(i).alias("issue"), F.coalesce(c, F.lit(False)).alias("found"), F.lit(m).alias("metric"), col(m).alias("value")) for i, c, m in rules])
    rows.append(facts.select("variable", F.explode(tried).alias("t")).where("t.found").select("t.issue", "variable", "t.metric", "t.value"))
    if kinds["numeric"]:
        counts = outlier_counts(df, kinds["numeric"], outlier_method, outlier_threshold).where("n > 0")
        rows.append(counts.select(F.lit("outliers").alias("issue"), "variable", F.lit("outlier_count").alias("metric"), col("n").cast("double").alias("value")))
    if kinds["character"]:
        top = character_profile(df).where((col("unique") == 2) & (col("top_freq") / col("n") > 0.95))
        rows.append(top.select(F.lit("near_zero_variance").alias("issue"), "variable", F.lit("top_pct").alias("metric"), col("top_pct").alias("value")))
    rows.append(duplicate_rows(df).where("n > 0").select(F.lit("duplicate_rows").alias("issue"), F.lit("*").alias("variable"), F.lit("n").alias("metric"), col("n").cast("double").alias("value")))
    empty = reduce(lambda a, b: a + b, [_gone(df, c).cast("int") for c in df.columns]) == n_cols
    rows.append(df.agg(F.count_if(empty).alias("n")).where("n > 0").select(F.lit("empty_rows").alias("issue"), F.lit("*").alias("variable"), F.lit("n").alias("metric"), col("n").cast("double").alias("value")))
    return _union(rows)


def issue_examples(df: DataFrame, n: int = 3, current_year: int | None = None) -> DataFrame:
    """(issue, variable, kind, examples): the n least values, as text, that make or (kind "problematic") hinder an issue.

    Of letter case: for the n least folded values that stand in several spellings, one row each with all spellings.
    """
    kinds = variable_types(df)
    year = F.lit(current_year) if current_year else F.year(F.current_date())
    cells = []
    for c in kinds["character"] + kinds["numeric"] + kinds["date"]:
        x, na = F.col(f"`{c}`"), _gone(df, c)
        if c in kinds["character"]:
            found = [("numeric_as_character", F.when(as_numeric(x).isNotNull(), "convertible").otherwise("problematic"), ~na), ("case_issues", F.lower(x), ~na)]
        elif c in kinds["numeric"]:
            found = [("negative_in_positive", F.lit("negative"), ~na & (x < 0))]
        else:
            found = [("suspicious_dates", F.lit("suspicious"), (F.year(x) < 1910) | (F.year(x) > year))]
        cells += [F.when(on, F.struct(F.lit(i).alias("issue"), F.lit(c).alias("variable"), k.alias("kind"), x.cast("string").alias("value"))) for i, k, on in found]
    if not cells:
        return df.sparkSession.createDataFrame([], "issue string, variable string, kind string, examples array<string>")
    values = df.select(F.explode(F.array_compact(F.array(*cells))).alias("e")).select("e.*").distinct()
    first = Window.partitionBy("issue", "variable", "kind").orderBy("value")
    cased = values.where("issue = 'case_issues'").groupBy("issue", "variable", "kind").agg(F.array_sort(F.collect_list("value")).alias("examples")).where(F.size("examples") > 1)
    cased = cased.withColumn("r", F.row_number().over(Window.partitionBy("variable").orderBy("kind"))).where(F.col("r") <= n).drop("r")
    others = values.where("issue <> 'case_issues'").withColumn("r", F.row_number().over(first)).where(F.col("r") <= n)
    others = others.groupBy("issue", "variable", "kind").agg(F.array_sort(F.collect_list("value")).alias("examples"))
    issues = quality_issues(df, current_year=current_year).select("issue", "variable").distinct()
    return others.unionByName(cased).join(F.broadcast(issues), ["issue", "variable"], "left_semi")


#: What to do about each issue.
ADVICE = {
    "numeric_as_character": "convert to numbers after cleaning",
    "missing_values": "consider imputation",
    "near_zero_variance": "consider leaving the variable out",
    "negative_in_positive": "check the sign of values",
    "empty_columns": "leave the variable out",
    "suspicious_dates": "check the dates",
    "low_cardinality": "treat as categories",
    "case_issues": "bring values to one case",
    "outliers": "check extreme values",
    "duplicate_rows": "remove repeated rows",
    "empty_rows": "remove empty rows",
}


#: Advice where more than this percentage of a variable is missing.
MOSTLY_MISSING, ADVICE_MOSTLY_MISSING = 50, "leave the variable out: more than half of it is missing"


def overall(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_columns, numbers of variables by type, and the share of all cells that are missing."""
    kinds, n = variable_types(df), len(df.columns)
    gone = reduce(lambda a, b: a + b, [_gone(df, c).cast("long") for c in df.columns], F.lit(0))
    counts = [F.lit(len(kinds[k])).alias(f"n_{k}") for k in ("numeric", "character", "logical", "date")]
    one = df.select(gone.alias("gone")).agg(F.count("*").alias("n_rows"), F.sum("gone").alias("gone"))
    return one.select("n_rows", F.lit(n).alias("n_columns"), *counts, F.round(100.0 * F.col("gone") / (n * F.col("n_rows")), 2).alias("missing_pct"))


@dataclass
class Overview:
    overall: DataFrame
    variable_types: dict[str, list[str]]
    numeric: DataFrame | None
    character: DataFrame | None
    logical: DataFrame | None
    issues: DataFrame
    recommendations: DataFrame
    examples: DataFrame


def data_overview(df: DataFrame, outlier_method: str = "iqr", outlier_threshold: float | None = None, sample: int | None = None, seed: int = 0, current_year: int | None = None) -> Overview:
    """All profiles and issues, lazily. sample: profile that many rows, chosen by a seeded order, instead of all."""
    if sample is not None:
        df = df.orderBy(F.rand(seed)).limit(sample)
    kinds = variable_types(df)
    issues = quality_issues(df, outlier_method, outlier_threshold, current_year)
    advice = F.create_map(*[F.lit(v) for p in ADVICE.items() for v in p])
    most = (F.col("issue") == "missing_values") & (F.col("value") > MOSTLY_MISSING)
    said = F.when(most, F.lit(ADVICE_MOSTLY_MISSING)).otherwise(advice[F.col("issue")])
    return Overview(overall(df), kinds, numeric_profile(df) if kinds["numeric"] else None, character_profile(df) if kinds["character"] else None, logical_profile(df) if kinds["logical"] else None, issues, issues.select("issue", "variable", said.alias("recommendation")).distinct(), issue_examples(df, current_year=current_year))
