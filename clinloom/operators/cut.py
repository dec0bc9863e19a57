"""Deriving categories from numbers."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinloom.operators.quantiles import quantiles

NUDGE = 1e-8


def force_increasing(values: list[float]) -> list[float]:
    """Each value at least a hundred-millionth above the one before."""
    out: list[float] = []
    for v in values:
        out.append(v if not out or v > out[-1] else out[-1] + NUDGE)
    return out


def _show(v: float) -> str:
    return f"{v:.3g}" if abs(v) < 1e15 else f"{v:g}"


def interval_names(edges: list[float], right: bool = False) -> list[str]:
    """[a,b) and so on, the last closed; more digits where three do not tell edges apart."""
    for digits in range(3, 18):
        text = [f"{e:.{digits}g}" for e in edges]
        if len(set(text)) == len(text):
            break
    n = len(edges) - 1
    if right:
        return [("[" if i == 0 else "(") + f"{text[i]},{text[i + 1]}]" for i in range(n)]
    return [f"[{text[i]},{text[i + 1]}" + ("]" if i == n - 1 else ")") for i in range(n)]


def _labels(n: int, label_type: str, names: list[str], labels: list[str] | None) -> list[str]:
    if labels is not None:
        if len(labels) != n:
            raise ValueError(f"{n} labels are needed")
        base = labels
    elif label_type == "ori":
        return names
    elif n == 2:
        base = ["Low", "High"]
    elif n == 3:
        base = ["Low", "Medium", "High"]
    else:
        raise ValueError("more than two breaks need labels of their own")
    return [f"{b} {i}" for b, i in zip(base, names)] if label_type == "combined" else list(base)


def _chain(x: Column, edges: list[Column], labels: list[str], right: bool) -> Column:
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for i, name in enumerate(labels[:-1]):
        out = out.when(x <= edges[i] if right else x < edges[i], F.lit(name))
    return out.otherwise(F.lit(labels[-1]))


def cut_by(df: DataFrame, column: str, breaks: list[float], out: str, breaks_as_quantiles: bool = False, group: str | None = None, labels: list[str] | None = None, label_type: str = "ori", right: bool = False, drop_empty: bool = True) -> DataFrame:
    """Adds a category by inner breaks, least and largest value being the outer ones.

    With group, quantiles are those of each group, and labels Low, (Medium,) High unless given. One
    aggregate finds the edges; by group they are joined. drop_empty warns of levels without
    rows (one more job).
    """
    if label_type not in ("ori", "LMH", "combined"):
        raise ValueError("unknown label type")
    breaks = sorted(breaks)
    x = F.col(column)
    if group is not None:
        if not breaks_as_quantiles:
            raise ValueError("groups go with quantiles")
        names = _labels(len(breaks) + 1, "LMH" if labels is None else "ori" if label_type == "ori" else label_type, labels or [], labels)
        q = quantiles(df, {"x": x}, [*breaks, 0.0, 1.0], [group]).select(F.col(group).alias("_g"), F.col("q_x").alias("_q"), F.col("q_x")[len(breaks) + 1].alias("_hi"), F.col("q_x")[len(breaks)].alias("_lo"))
        joined = df.join(q, df[group].eqNullSafe(q["_g"]), "left")
        flat = F.when(x.isNotNull() & (F.col("_lo") == F.col("_hi")), F.lit(names[0]))
        cat = F.coalesce(flat, _chain(x, [F.col("_q")[i] for i in range(len(breaks))], names, right))
        return joined.withColumn(out, cat).select(*df.columns, out)
    if breaks_as_quantiles:
        q = F.col("q_x")
        row = quantiles(df, {"x": x}, [*breaks, 0.0, 1.0]).select(q[len(breaks)].alias("lo"), q[len(breaks) + 1].alias("hi"), F.slice(q, 1, len(breaks)).alias("q")).first()
    else:
        row = df.agg(F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi")).first()
    if row["lo"] is None:
        return df.withColumn(out, F.lit(None).cast("string"))
    inner = list(row["q"]) if breaks_as_quantiles else [float(b) for b in breaks]
    if not breaks_as_quantiles and (inner[0] <= row["lo"] or inner[-1] >= row["hi"]):
        raise ValueError("breaks lie outside the values")
    edges = force_increasing([row["lo"], *inner, row["hi"]])
    names = _labels(len(edges) - 1, label_type, interval_names(edges, right), labels)
    got = df.withColumn(out, _chain(x, [F.lit(e) for e in edges[1:-1]], names, right))
    if drop_empty:
        have = {r[0] for r in got.select(out).distinct().collect()}
        if empty := [n for n in names if n not in have]:
            warnings.warn(f"levels without rows: {empty}", stacklevel=2)
    return got
