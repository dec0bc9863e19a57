"""Exact quantiles (type 7) of any number of groups and rows, with state of fixed size.

Where no group has more than PLAIN values, Spark's own percentile is used: what it keeps of a group is then bounded. Else
a sketch of each group brackets every quantile between two of its values. Rows below a bracket are only
counted, rows within it are counted by value, and the two neighbours of the quantile are read off the running
counts. Where a bracket would hold many values it is first narrowed by sketches of what lies in it. So a task holds
for a group a sketch, or a few thousand values, however large the group is and however often a value comes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of a group that are counted one by one for a quantile, about; and the sketch's accuracy (an error of 1 in so many ranks).
GATHER, ACCURACY, GRID = 8192, 2000, 128
#: Values of a group up to which percentile, which keeps each distinct one, is taken.
PLAIN = 100_000
_INF = float("inf")


def _joined(df: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with its group's columns; null is a group."""
    named = side.withColumnsRenamed({k: f"_s{k}" for k in keys})
    on = [df[k].eqNullSafe(named[f"_s{k}"]) for k in keys] or F.lit(True)
    return df.join(named, on).drop(*[f"_s{k}" for k in keys])


def largest(df: DataFrame, by: list[str]) -> int:
    """The rows of the largest group."""
    return df.groupBy(*by).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0


def quantiles(df: DataFrame, columns: dict[str, Column], probs: list[float], by: list[str] | None = None, gather: int = GATHER, plain: int = PLAIN, most: int | None = None) -> DataFrame:
    """By group (columns by...), for each named number n_<name>, its values that are neither null nor NaN, and q_<name>, an array of its quantiles.

    most: how many rows the largest group has, if that is known. A group without values has an array of nulls. Several numbers are summed up side by side, as groups of one column.
    """
    by, names = by or [], list(columns)
    groups = [f"_g{i}" for i in range(len(by))]
    clean = [F.when(F.isnan(c.cast("double")), None).otherwise(c.cast("double")) for c in columns.values()]
    if (largest(df, by) if most is None else most) <= plain:
        flat = df.select(*[F.col(c).alias(g) for c, g in zip(by, groups)], *[c.alias(f"_x{j}") for j, c in enumerate(clean)])
        aggs = [a for j, name in enumerate(names) for a in (F.count(f"_x{j}").alias(f"n_{name}"), F.percentile(f"_x{j}", F.array(*[F.lit(float(p)) for p in probs])).alias(f"_q{j}"))]
        none = F.array(*[F.lit(None).cast("double")] * len(probs))
        res = [c for j, name in enumerate(names) for c in (F.col(f"n_{name}"), F.coalesce(f"_q{j}", none).alias(f"q_{name}"))]
        return flat.groupBy(*groups).agg(*aggs).select(*[F.col(g).alias(c) for c, g in zip(by, groups)], *res)
    rows = df.select(*[F.col(c).alias(g) for c, g in zip(by, groups)], *([clean[0].alias("_x")] if len(names) == 1 else [F.explode(F.array(*[F.struct(F.lit(j).alias("_j"), c.alias("_x")) for j, c in enumerate(clean)])).alias("e")]))
    if len(names) > 1:
        rows = rows.select(*groups, "e._j", "e._x")
    out = _of_one(rows, [*groups, *(["_j"] if len(names) > 1 else [])], probs, gather)
    whole = F.struct("_n", "_q")
    if len(names) == 1:
        res = [F.col("_n").alias(f"n_{names[0]}"), F.col("_q").alias(f"q_{names[0]}")]
        return out.select(*[F.col(g).alias(c) for c, g in zip(by, groups)], *res)
    wide = out.groupBy(*groups).agg(*[F.max(F.when(F.col("_j") == j, whole)).alias(f"_r{j}") for j in range(len(names))])
    none = F.array(*[F.lit(None).cast("double")] * len(probs))
    res = [c for j, name in enumerate(names) for c in (F.coalesce(F.col(f"_r{j}._n"), F.lit(0)).alias(f"n_{name}"), F.coalesce(F.col(f"_r{j}._q"), none).alias(f"q_{name}"))]
    return wide.select(*[F.col(g).alias(c) for c, g in zip(by, groups)], *res)


def _of_one(rows: DataFrame, keys: list[str], probs: list[float], gather: int) -> DataFrame:
    """(keys..., _n, _q) of one column _x."""
    x, n, some = F.col("_x"), F.col("_n"), range(len(probs))
    # the least and the greatest value bound the outermost brackets, as a sketch may miss them
    ends = [(p - 3 / ACCURACY, p + 3 / ACCURACY) for p in probs]
    asked = [min(max(v, 0.0), 1.0) for e in ends for v in e]
    small = n <= max(gather // 2, 2 * ACCURACY)  # else a bracket would be narrower than some ranks
    low = [F.lit(-_INF) if e[0] <= 0 else F.when(small, F.lit(-_INF)).otherwise(F.col("_e")[2 * i]) for i, e in enumerate(ends)]
    high = [F.lit(_INF) if e[1] >= 1 else F.when(small, F.lit(_INF)).otherwise(F.col("_e")[2 * i + 1]) for i, e in enumerate(ends)]
    state = rows.groupBy(*keys).agg(F.count("_x").alias("_n"), F.percentile_approx("_x", asked, ACCURACY).alias("_e"))
    state = state.select(*keys, "_n", F.array(*low).alias("_lo"), F.array(*high).alias("_hi"))
    own = [k for k in keys if k != "_j"]
    if own:
        state = state.persist()  # a row a group
    least = None if own else state.collect()
    inside = ((state.agg(F.max("_n")).first()[0] if own else max((r["_n"] for r in least), default=0)) or 0) * 6 // ACCURACY
    while inside > gather:
        state, inside = _narrowed(rows, state, keys, probs, small).persist(), inside * 6 // GRID
        least = None if own else state.collect()
    if own:
        both = _joined(rows, state, keys)
    else:  # a row a column: its numbers go into the plan
        at = {r["_j"] if keys else 0: r for r in least}
        known = lambda c: F.array(*[F.lit(at[j][c]) if c == "_n" else F.array(*map(F.lit, at[j][c])) for j in sorted(at)])[F.col("_j") if keys else F.lit(0)]
        both = rows.select("*", *[known(c).alias(c) for c in ("_n", "_lo", "_hi")]) if at else rows.select("*", *[F.lit(None).cast(state.schema[c].dataType).alias(c) for c in ("_n", "_lo", "_hi")])
    # all quantiles of a small group are read off one list; a group without values keeps its row
    entry = [F.when((x <= F.col("_hi")[i]) & (F.lit(i == 0) | ~small), F.struct(F.lit(i).alias("at"), F.when(x < F.col("_lo")[i], F.lit(-_INF)).otherwise(x).alias("x"))) for i in some]
    entry.append(F.when(n == 0, F.struct(F.lit(-1).alias("at"), F.lit(None).cast("double").alias("x"))))
    held = both.select(*keys, "_n", F.explode(F.filter(F.array(*entry), lambda e: e.isNotNull())).alias("e"))
    held = held.groupBy(*keys, "_n", F.col("e.at").alias("_at"), F.col("e.x").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_n", "_at").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    held = held.withColumn("_to", upto)
    place = [(n - 1) * F.lit(float(p)) for p in probs]
    found = []
    for i in some:
        here = (F.col("_at") == i) | (F.col("_at") == 0) & small
        for side, rank in (("a", F.floor(place[i])), ("b", F.least(F.floor(place[i]) + 1, n - 1))):
            found.append(F.max(F.when(here & (F.col("_to") - F.col("_c") <= rank) & (rank < F.col("_to")), F.col("_v"))).alias(f"_{side}{i}"))
    out = held.groupBy(*keys, "_n").agg(*found) if keys else held.groupBy().agg(F.coalesce(F.max("_n"), F.lit(0)).alias("_n"), *found)
    share = [h - F.floor(h) for h in place]
    between = [F.when(n > 0, F.col(f"_a{i}") + F.when(share[i] == 0, F.lit(0.0)).otherwise((F.col(f"_b{i}") - F.col(f"_a{i}")) * share[i])) for i in some]
    return out.select(*keys, "_n", F.array(*between).alias("_q"))


def _narrowed(rows: DataFrame, state: DataFrame, keys: list[str], probs: list[float], small: Column) -> DataFrame:
    """Brackets within the brackets: a grid of each one's quantiles, and of these the two around the wanted ranks."""
    x, aggs, lows, highs = F.col("_x"), [], [], []
    for i, p in enumerate(probs):
        lo, hi = F.col("_lo")[i], F.col("_hi")[i]
        inside = F.when((x >= lo) & (x <= hi), x)
        aggs += [F.count_if(x < lo).alias(f"_b{i}"), F.count(inside).alias(f"_c{i}"), F.percentile_approx(inside, [t / GRID for t in range(GRID + 1)], ACCURACY).alias(f"_q{i}")]
        rank, q = F.floor((F.col("_n") - 1) * F.lit(float(p))) - F.col(f"_b{i}"), F.col(f"_q{i}")
        at = F.floor(rank / F.greatest(F.col(f"_c{i}"), F.lit(1)) * GRID).cast("int")
        few = small | (F.col(f"_c{i}") <= 8 * GRID)  # a step of the grid would be less than a few ranks
        lows.append(F.when(few | (at - 2 <= 0), lo).otherwise(q[F.greatest(at - 2, F.lit(0))]))
        highs.append(F.when(few | (at + 3 >= GRID), hi).otherwise(q[F.least(at + 3, F.lit(GRID))]))
    g = _joined(rows, state, keys).groupBy(*keys, "_n", "_lo", "_hi").agg(*aggs)
    return g.select(*keys, "_n", F.array(*lows).alias("_lo"), F.array(*highs).alias("_hi"))
