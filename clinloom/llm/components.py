"""Connected components of an edge table, by repeated contraction; nothing is gathered on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinloom.llm.common import materialize

MAX_ROUNDS = 200
#: So few edges, at most, are closed in one task. More go through rounds until no more than these are left.
FEW_EDGES = 10_000


def _closed(edges: DataFrame) -> DataFrame:
    """(node, component) of a stored table of few edges, in one task."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches):
        least: dict = {}  # a way to the smallest node of each node's component

        def find(x):
            while (up := least.setdefault(x, x)) != x:
                least[x] = x = least[up]
            return x

        batch = None
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = find(a), find(b)
                least[max(x, y)] = min(x, y)
        if least:
            of = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array(list(least), of), pa.array([find(x) for x in list(least)], of)], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def connected_components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(node, component): component is the smallest node reachable; only nodes with an edge to another are listed.

    edges: (a, b) of whole numbers; direction, loops, repeats and nulls do not matter. In each
    round every node joins its best neighbour (or itself) and edges move to the nodes joined, so
    a star closes in one round; every second round ranks nodes by a hash, so a long path halves.
    Where no more than `few` edges are left, one task closes them.
    """
    live = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    live = materialize(live.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    for k in range(MAX_ROUNDS):
        left = live.count()
        if not left:
            break
        if left <= few:
            closed = _closed(live)
            if labels is None:
                return closed
            labels = labels.join(closed.withColumnRenamed("component", "w"), labels.c == closed.node, "left").select(labels.node, F.coalesce("w", "c").alias("c"))
            break
        rank = F.col("v") if k % 2 == 0 else F.xxhash64("v", F.lit(k))
        both = live.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(live.select(F.col("b").alias("u"), F.col("a").alias("v")))
        best = both.groupBy("u").agg(F.min(F.struct(rank.alias("r"), F.col("v"))).alias("m"))
        own = F.struct((F.col("u") if k % 2 == 0 else F.xxhash64("u", F.lit(k))).alias("r"), F.col("u").alias("v"))
        moved = materialize(best.select("u", F.least(F.col("m"), own).getField("v").alias("w")))
        if labels is None:
            labels = moved.select(F.col("u").alias("node"), F.col("w").alias("c"))
        else:
            labels = labels.join(moved, labels.c == moved.u, "left").select("node", F.coalesce("w", "c").alias("c"))
        labels = materialize(labels)
        to_a, to_b = moved.select(F.col("u").alias("a"), F.col("w").alias("x")), moved.select(F.col("u").alias("b"), F.col("w").alias("y"))
        live = live.join(to_a, "a").join(to_b, "b").where(F.col("x") != F.col("y"))
        live = materialize(live.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    else:
        raise RuntimeError(f"components did not close in {MAX_ROUNDS} rounds")
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = labels.groupBy("c").agg(F.min("node").alias("component"))
    return labels.join(least, "c").select("node", "component")
