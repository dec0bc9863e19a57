"""Scans along an order within groups, split over tasks however large a group is.

Groups of up to WINDOW_ROWS rows are windows of their own. Where a group is larger it is cut at quantiles of a sketch of its
order, so its pieces have about the same number of rows however the values lie. A window runs within each piece; what a
piece hands on to the later (or earlier) ones is combined over the pieces, a few rows a group, and joined back. No task
holds a large group whole, and rows without a group are no exception.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECES, WINDOW_ROWS = 128, 100_000


def is_large(df: DataFrame, keys: list[str], most: int = WINDOW_ROWS) -> bool:
    """Whether any group has more rows than one window should hold: one job of counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most).limit(1).count() > 0


def cut(df: DataFrame, keys: list[str], order: str, pieces: int = PIECES, most: int = WINDOW_ROWS) -> DataFrame:
    """Adds _p, the piece of each row: an int that rises with the order; rows of one place are in one piece. Null is a group.

    Groups of at most `most` rows are one piece.
    """
    # the sketch's error is a small part of a piece
    edges = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx(order, [i / pieces for i in range(1, pieces)], 20 * pieces).alias("_cuts")).where(F.col("_n") > most)
    edges = edges.select(*[F.col(k).alias(f"_e{i}") for i, k in enumerate(keys)], "_cuts")
    cond = [df[k].eqNullSafe(edges[f"_e{i}"]) for i, k in enumerate(keys)] or [F.lit(True)]
    place = F.when(F.col("_cuts").isNull(), F.lit(0)).when(F.col(order).isNull(), F.lit(-1)).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col(order))))
    return df.join(edges, cond, "left").withColumn("_p", place).drop("_cuts", *[f"_e{i}" for i in range(len(keys))])


def _beside(pieces: DataFrame, totals: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    """Rows beside columns of their piece's total."""
    t = totals.select(*[F.col(k).alias(f"_e{i}") for i, k in enumerate(keys)], F.col("_p").alias("_q"), *[v.alias(k) for k, v in columns.items()])
    on = [*[pieces[k].eqNullSafe(t[f"_e{i}"]) for i, k in enumerate(keys)], pieces["_p"] == t["_q"]]
    return pieces.join(t, on).drop("_q", *[f"_e{i}" for i in range(len(keys))])


def running_sum(df: DataFrame, keys: list[str], order: str, cols: list[str], descending: bool = False, pieces: int = PIECES, most: int = WINDOW_ROWS) -> DataFrame:
    """Adds cum_<c> for each c: the sum over the group's rows up to each row, inclusive, by a numeric order without ties."""
    names, way = [F.col(k) for k in keys], F.desc(order) if descending else F.asc(order)
    if not is_large(df, keys, most):
        whole = Window.partitionBy(*names).orderBy(way).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({f"cum_{c}": F.sum(c).over(whole) for c in cols})
    rows = cut(df, keys, order, pieces, most)
    totals = rows.groupBy(*keys, "_p").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    before = Window.partitionBy(*names).orderBy(F.desc("_p") if descending else F.asc("_p")).rowsBetween(Window.unboundedPreceding, -1)
    out = _beside(rows, totals, keys, {f"_b_{c}": F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)) for c in cols})
    inside = Window.partitionBy(*names, "_p").orderBy(way).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {f"cum_{c}": F.sum(c).over(inside) + F.col(f"_b_{c}") for c in cols}
    return out.withColumns(sums).select(*df.columns, *sums)


def last_valid(df: DataFrame, keys: list[str], order: str, x: str, out: str, pieces: int = PIECES, most: int = WINDOW_ROWS) -> DataFrame:
    """Adds the last value of x that is not null, up to each row by the order. Rows without a place in the order come first, in no order."""
    names = [F.col(k) for k in keys]
    if not is_large(df, keys, most):
        whole = Window.partitionBy(*names).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(out, F.last(x, ignorenulls=True).over(whole))
    rows = cut(df, keys, order, pieces, most)
    totals = rows.groupBy(*keys, "_p").agg(F.max_by(x, F.when(F.col(x).isNotNull(), F.struct(F.col(order).isNotNull().alias("a"), F.col(order).alias("b")))).alias("_last"))
    before = Window.partitionBy(*names).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    got = _beside(rows, totals, keys, {"_before": F.last("_last", ignorenulls=True).over(before)})
    inside = Window.partitionBy(*names, "_p").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return got.withColumn(out, F.coalesce(F.last(x, ignorenulls=True).over(inside), "_before")).select(*[c for c in df.columns if c != out], out)


def max_before(df: DataFrame, keys: list[str], order: str, x: str, out: str, pieces: int = PIECES, most: int = WINDOW_ROWS) -> DataFrame:
    """Adds the greatest x of the rows before each row, by an order without ties; null for the first."""
    names = [F.col(k) for k in keys]
    if not is_large(df, keys, most):
        return df.withColumn(out, F.max(x).over(Window.partitionBy(*names).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)))
    rows = cut(df, keys, order, pieces, most)
    totals = rows.groupBy(*keys, "_p").agg(F.max(x).alias("_top"))
    before = Window.partitionBy(*names).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    got = _beside(rows, totals, keys, {"_before": F.max("_top").over(before)})
    inside = Window.partitionBy(*names, "_p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return got.withColumn(out, F.greatest(F.max(x).over(inside), "_before")).select(*df.columns, out)


def next_value(df: DataFrame, keys: list[str], order: str, x: str, out: str, pieces: int = PIECES, most: int = WINDOW_ROWS) -> DataFrame:
    """Adds x of the row after each row, by an order without ties; null for the last."""
    names = [F.col(k) for k in keys]
    if not is_large(df, keys, most):
        return df.withColumn(out, F.lead(x).over(Window.partitionBy(*names).orderBy(order)))
    rows = cut(df, keys, order, pieces, most)
    totals = rows.groupBy(*keys, "_p").agg(F.min_by(x, order).alias("_first"))
    got = _beside(rows, totals, keys, {"_after": F.lead("_first").over(Window.partitionBy(*names).orderBy("_p"))})
    inside = Window.partitionBy(*names, "_p").orderBy(order)
    last = F.lead(F.lit(1)).over(inside).isNull()
    return got.withColumn(out, F.when(last, F.col("_after")).otherwise(F.lead(x).over(inside))).select(*df.columns, out)


def clip_bounds(blocks: DataFrame, keys: list[str], start: str, end: str, relaxed: str, infinity: float, most: int = WINDOW_ROWS, large: bool | None = None) -> DataFrame:
    """Adds _left, the relaxed start cut back to the greatest earlier end, and _next, the next row's _left (infinity for the last); starts have no ties. large: whether a group exceeds `most`, if that is known."""
    left = lambda top: F.least(start, F.greatest(relaxed, F.coalesce(top, F.lit(-infinity))))
    if not (is_large(blocks, keys, most) if large is None else large):
        w = Window.partitionBy(*[F.col(k) for k in keys]).orderBy(start)
        blocks = blocks.withColumn("_left", left(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))))
        return blocks.withColumn("_next", F.coalesce(F.lead("_left").over(w), F.lit(infinity)))
    blocks = max_before(blocks, keys, start, end, "_prev", most=most).withColumn("_left", left(F.col("_prev")))
    return next_value(blocks, keys, start, "_left", "_next", most=most).withColumn("_next", F.coalesce("_next", F.lit(infinity))).drop("_prev")
