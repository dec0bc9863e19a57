"""Outlier flags by column or group, null where the value is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinloom.operators.quantiles import largest, quantiles

MAD_SCALE = 1.4826
DEFAULTS = {"mad": MAD_SCALE * 3, "iqr": 1.5, "zscore": 3.0}


def _with_quantiles(df: DataFrame, by: list[str], x: Column, probs: list[float], most: int | None = None) -> DataFrame:
    """Quantiles of each group, as _q, beside its rows."""
    q = quantiles(df, {"x": x}, probs, by, most=most).withColumnsRenamed({c: f"_g{i}" for i, c in enumerate(by)}).withColumnRenamed("q_x", "_q").drop("n_x")
    return df.join(q, [df[c].eqNullSafe(q[f"_g{i}"]) for i, c in enumerate(by)] or F.lit(True)).drop(*[f"_g{i}" for i in range(len(by))])


def _with_stats(df: DataFrame, by: list[str], **aggs: Column) -> DataFrame:
    """Statistics of each group beside its rows: an aggregate joined back, not a window over whole groups."""
    named = [v.alias(k) for k, v in aggs.items()]
    if not by:
        return df.join(df.agg(*named), F.lit(True))
    stats = df.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]).agg(*named)
    return df.join(stats, [df[c].eqNullSafe(stats[f"_g{i}"]) for i, c in enumerate(by)]).drop(*[f"_g{i}" for i in range(len(by))])


def flag_outliers(df: DataFrame, column: str, method: str = "iqr", threshold: float | None = None, partition_by: list[str] | None = None, out: str = "outlier") -> DataFrame:
    """mad: farther from the median than threshold times the scaled median deviation. iqr: outside the
    quartiles by more than threshold times their distance. zscore: more than threshold standard
    deviations from the mean; a constant has none."""
    if method not in DEFAULTS:
        raise ValueError(f"unknown method {method}")
    k, by, x = DEFAULTS[method] if threshold is None else threshold, partition_by or [], F.col(column).cast("double")
    if method == "mad":
        most = largest(df, by)
        one = _with_quantiles(df, by, x, [0.5], most).withColumn("_med", F.col("_q")[0]).drop("_q")
        two = _with_quantiles(one, by, F.abs(x - F.col("_med")), [0.5], most)
        return two.withColumn(out, F.abs(x - F.col("_med")) > k * MAD_SCALE * F.col("_q")[0]).select(*df.columns, out)
    if method == "iqr":
        one = _with_quantiles(df, by, x, [0.25, 0.75])
        q1, q3 = F.col("_q")[0], F.col("_q")[1]
        return one.withColumn(out, (x < q1 - k * (q3 - q1)) | (x > q3 + k * (q3 - q1))).select(*df.columns, out)
    one = _with_stats(df, by, _m=F.avg(x), _s=F.stddev_samp(x))
    flag = F.when(x.isNotNull() & (F.coalesce("_s", F.lit(0.0)) == 0), F.lit(False)).otherwise(F.abs(x - F.col("_m")) / F.nullif("_s", F.lit(0.0)) > k)
    return one.withColumn(out, flag).select(*df.columns, out)


def mad_outlier(df: DataFrame, column: str, threshold: float | None = None, **more) -> DataFrame:
    return flag_outliers(df, column, "mad", threshold, **more)


def iqr_outlier(df: DataFrame, column: str, threshold: float | None = None, **more) -> DataFrame:
    return flag_outliers(df, column, "iqr", threshold, **more)


def zscore_outlier(df: DataFrame, column: str, threshold: float | None = None, **more) -> DataFrame:
    return flag_outliers(df, column, "zscore", threshold, **more)


def detect_outliers(df: DataFrame, column: str, method: str = "iqr", threshold: float | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """By group: count and pct of outliers; least, largest and variance with and without them."""
    flagged = flag_outliers(df, column, method, threshold, partition_by, "_o")
    x = F.col(column).cast("double")
    kept = F.when(~F.col("_o"), x)
    g = flagged.groupBy(*(partition_by or [])).agg(
        F.count_if("_o").alias("outlier_count"),
        F.coalesce(100.0 * F.count_if("_o") / F.nullif(F.count(x), F.lit(0)), F.lit(0.0)).alias("outlier_pct"),
        F.min(x).alias("min_before"), F.max(x).alias("max_before"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("var_before"),
        F.min(kept).alias("min_after"), F.max(kept).alias("max_after"), F.coalesce(F.var_samp(kept), F.lit(0.0)).alias("var_after"),
    )
    k = DEFAULTS[method] if threshold is None else threshold
    return g.withColumns({"outlier_pct": F.round("outlier_pct", 2), "method": F.lit(method), "threshold": F.lit(float(k))})


def outlier_counts(df: DataFrame, columns: list[str], method: str = "iqr", threshold: float | None = None) -> DataFrame:
    """(variable, n): the outliers of each column; a few passes over the data, however many columns."""
    if method not in DEFAULTS:
        raise ValueError(f"unknown method {method}")
    k = DEFAULTS[method] if threshold is None else threshold
    x = {i: F.col(f"`{c}`").cast("double") for i, c in enumerate(columns)}
    if method == "iqr":
        stats = quantiles(df, {str(i): x[i] for i in x}, [0.25, 0.75]).select(*[F.col(f"q_{i}").alias(f"_q{i}") for i in x])
        flag = {i: (x[i] < F.col(f"_q{i}")[0] - k * (F.col(f"_q{i}")[1] - F.col(f"_q{i}")[0])) | (x[i] > F.col(f"_q{i}")[1] + k * (F.col(f"_q{i}")[1] - F.col(f"_q{i}")[0])) for i in x}
    elif method == "zscore":
        stats = df.agg(*[a for i in x for a in (F.avg(x[i]).alias(f"_m{i}"), F.stddev_samp(x[i]).alias(f"_s{i}"))])
        flag = {i: F.abs(x[i] - F.col(f"_m{i}")) / F.nullif(F.col(f"_s{i}"), F.lit(0.0)) > k for i in x}
    else:
        most = largest(df, [])
        mid = quantiles(df, {str(i): x[i] for i in x}, [0.5], most=most).select(*[F.col(f"q_{i}")[0].alias(f"_m{i}") for i in x])
        df = df.join(mid, F.lit(True))
        stats = quantiles(df, {str(i): F.abs(x[i] - F.col(f"_m{i}")) for i in x}, [0.5], most=most).select(*[F.col(f"q_{i}")[0].alias(f"_d{i}") for i in x])
        flag = {i: F.abs(x[i] - F.col(f"_m{i}")) > k * MAD_SCALE * F.col(f"_d{i}") for i in x}
    row = df.join(stats, F.lit(True)).agg(*[F.count_if(flag[i]).alias(f"n{i}") for i in x])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"n{i}").alias("n")) for i, c in enumerate(columns)])).alias("r")).select("r.*")
