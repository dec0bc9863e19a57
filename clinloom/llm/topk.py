"""Exact top-k search by integer inner product over an impact-ordered index.

Index: vectors are dealt into blocks; a block's components are split by the size of
their quantised impact into posting segments, the largest impacts first. Search goes
score-at-a-time: segment after segment, each query's accumulators grow by what the
segment's postings add. What the later segments can still add to or take from a score
is bounded by the query's absolute weights times the largest impact left in each
dimension. A query stops in a block only on proof: when its kth best lower bound (or
the best bound brought from earlier blocks) exceeds what every non-member can reach.
Possible members are then rescored exactly.

Queries are a stated set. Blocks of queries meet all blocks of the index as rows of two tables,
so nothing passes through the driver; a task carries each query's bar from block to block.

Defined cases: vectors that are null, empty or hold null or non-finite components take
no part, as queries or candidates; vectors of another length than the query's are no
candidates of it; a query's own row is every row of its id; ties go to the smaller id;
fewer than k candidates are returned all; repeated ids count as separate candidates; equal
rows of a query count once, and different vectors of one query id are each a query with k results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clinloom.llm.common import materialize, table

BLOCK_ROWS = 2048
#: Queries in a block, at most.
QUERY_BLOCK = 4096
#: Lower edges of the impact classes, as shares of the block's largest impact.
EDGES = (0.5, 0.25, 0.125, 0.0)


def quantize(df: DataFrame, vector: str, scale: float) -> DataFrame:
    """floor(scale * x) of every component; rows that take no part go."""
    x = F.col(vector)
    ok = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return df.where(x.isNotNull() & (F.size(x) > 0)).where(ok).withColumn("_q", F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(float(scale))).cast("long")))


def build_index(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """One row a block: its ids, and by impact class the postings (row, dimension, value)."""

    def blocks(batches):
        wait: dict[int, list] = {}

        def flush(dim):
            ids, rows = zip(*wait.pop(dim))
            m = np.array(rows, dtype=np.int64)
            size = np.abs(m)
            top = size.max(initial=1)
            level = np.searchsorted(-np.array(EDGES) * top, -size, side="left")
            seg = []
            for k in range(len(EDGES)):
                r, d = np.nonzero((level == k) & (m != 0))
                seg.append((r.astype("<u4").tobytes(), d.astype("<u4").tobytes(), m[r, d].astype("<i8").tobytes(), np.where(level >= k, size, 0).max(axis=0).astype("<i8").tobytes()))
            return {"dim": dim, "ids": np.array(ids, dtype="<i8").tobytes(), "rows": [s[0] for s in seg], "dims": [s[1] for s in seg], "vals": [s[2] for s in seg], "left": [s[3] for s in seg]}

        for b in batches:
            out = []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = wait.setdefault(len(v), [])
                w.append((i, v))
                if len(w) >= BLOCK_ROWS:
                    out.append(flush(len(v)))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        for dim in list(wait):
            yield pa.RecordBatch.from_pylist([flush(dim)], schema=schema)

    schema = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("rows", pa.list_(pa.binary())), ("dims", pa.list_(pa.binary())), ("vals", pa.list_(pa.binary())), ("left", pa.list_(pa.binary()))])
    q = quantize(df.where(F.col(vec_id).isNotNull()), vector, scale).select(vec_id, "_q")
    return q.mapInArrow(blocks, "dim int, ids binary, rows array<binary>, dims array<binary>, vals array<binary>, left array<binary>")


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b in whole numbers: doubles hold them exactly below 2^53, else 64-bit integers are multiplied."""
    if a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def search_block(block: dict, qids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of all rows of the block that may be among a query's k best. floor: scores that k candidates reach already."""
    ids = np.frombuffer(block["ids"], dtype="<i8")
    n, dim = len(ids), block["dim"]
    levels = len(block["rows"])
    full = np.zeros((n, dim), dtype=np.int64)
    postings = [tuple(np.frombuffer(block[c][j], dtype=t) for c, t in (("rows", "<u4"), ("dims", "<u4"), ("vals", "<i8"))) for j in range(levels)]
    for r, d, v in postings:
        full[r, d] = v
    rows = np.arange(n)  # that some query may still need
    left = [np.frombuffer(x, dtype="<i8") for x in block["left"]] + [np.zeros(dim, dtype=np.int64)]
    live = np.arange(len(q))
    acc = np.zeros((len(q), n), dtype=np.int64)
    own = qids[:, None] == ids[None, :]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = np.abs(q)
    for j in range(levels):
        if not len(live):
            break
        r, d, v = postings[j]
        place = np.full(n, -1)
        place[rows] = np.arange(len(rows))
        here = place[r]
        part = np.zeros((len(rows), dim), dtype=np.int64)
        part[here[here >= 0], d[here >= 0]] = v[here >= 0]
        used = np.flatnonzero(part.any(axis=0))  # dimensions with postings in this segment
        acc[np.ix_(live, rows)] += _dot(q[np.ix_(live, used)], part[:, used].T)
        slack = size[live] @ left[j + 1]
        a = np.where(own[live], np.iinfo(np.int64).min // 4, acc[live])
        kth = np.full(len(live), np.iinfo(np.int64).min // 2)
        if n > k:
            kth = np.partition(a, n - k, axis=1)[:, n - k] - slack
        bar = np.maximum(kth, floor[live])
        may = (a + slack[:, None] >= bar[:, None]) & ~own[live]
        count = may.sum(axis=1)
        done = (count <= 2 * k) if j + 1 < levels else np.ones(len(live), dtype=bool)
        if done.any():
            r, c = np.nonzero(may[done])
            qi = live[done][r]
            score = np.einsum("ij,ij->i", q[qi], full[c])
            out.append((qi, ids[c], score))
        # a row that no open query may need takes no more postings: its bound lies under every bar, and bars only rise
        rows, live = np.flatnonzero(may[~done].any(axis=0)), live[~done]
        ruled = np.ones(n, dtype=bool)
        ruled[rows] = False
        acc[np.ix_(live, np.flatnonzero(ruled))] = np.iinfo(np.int64).min // 4
    if not out:
        z = np.empty(0, dtype=np.int64)
        return z, z, z
    return tuple(np.concatenate(x) for x in zip(*out))


def _best(qi: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best, ties to the smaller id."""
    order = np.lexsort((ids, -score, qi))
    s = qi[order]
    start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.empty(0, int)
    rank = np.arange(len(s)) - np.repeat(start, np.diff(np.r_[start, len(s)]))
    return order[rank < k]


_QUERIES = "dim int, qids binary, qkeys binary, q binary"


def query_blocks(queries: DataFrame, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Rows of at most query_block queries of one length: their ids, keys that tell vectors of one id apart, and vectors."""
    schema = pa.schema([("dim", pa.int32()), ("qids", pa.binary()), ("qkeys", pa.binary()), ("q", pa.binary())])

    def run(batches):
        wait: dict[int, list] = {}

        def flush(dim):
            ids, keys, rows = zip(*wait.pop(dim))
            return pa.RecordBatch.from_pylist([{"dim": dim, "qids": np.array(ids, dtype="<i8").tobytes(), "qkeys": np.array(keys, dtype="<i8").tobytes(), "q": np.array(rows, dtype="<i8").tobytes()}], schema=schema)

        for b in batches:
            for i, k, v in zip(*(c.to_pylist() for c in b.columns)):
                w = wait.setdefault(len(v), [])
                w.append((i, k, v))
                if len(w) >= query_block:
                    yield flush(len(v))
        for dim in list(wait):
            yield flush(dim)

    rows = queries.select("query_id", F.xxhash64("q").alias("k"), "q").dropDuplicates(["query_id", "q"])
    return rows.mapInArrow(run, _QUERIES)


def search(index: DataFrame, queries: DataFrame, k: int = 20, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best. queries: (query_id, q array<long>).

    Every task meets some blocks of queries with some blocks of the index and keeps each query's k best of them.
    """
    blocks = materialize(query_blocks(queries, query_block))
    met = blocks.hint("shuffle_replicate_nl").join(index.withColumnRenamed("dim", "d"), F.col("dim") == F.col("d"))

    def scan(batches):
        z = np.empty(0, dtype=np.int64)
        now, qids, keys, q, best, floor = None, z, z, z, (z, z, z), z

        def found():
            if len(best[0]):
                yield pa.RecordBatch.from_pydict({"query_id": qids[best[0]], "query_key": keys[best[0]], "vec_id": best[1], "score": best[2]})

        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                if (row["qids"], row["q"]) != now:  # blocks of queries follow one another
                    yield from found()
                    now, best = (row["qids"], row["q"]), (z, z, z)
                    qids, keys = (np.frombuffer(row[c], dtype="<i8") for c in ("qids", "qkeys"))
                    q = np.frombuffer(row["q"], dtype="<i8").reshape(len(qids), -1)
                    floor = np.full(len(qids), np.iinfo(np.int64).min // 2)
                for lo in range(0, len(qids), 512):
                    s = slice(lo, lo + 512)
                    qi, ids, score = search_block(row, qids[s], q[s], k, floor[s])
                    best = tuple(np.concatenate(x) for x in zip(best, (qi + lo, ids, score)))
                keep = _best(*best, k)
                best = tuple(x[keep] for x in best)
                count = np.bincount(best[0], minlength=len(qids))
                low = np.full(len(qids), np.iinfo(np.int64).max)
                np.minimum.at(low, best[0], best[2])
                floor = np.where(count >= k, low, floor)
        yield from found()

    local = met.select("dim", "qids", "qkeys", "q", "ids", "rows", "dims", "vals", "left").mapInArrow(scan, "query_id long, query_key long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = materialize(build_index(e, scale=64.0))
    queries = quantize(e.where(F.col("vec_id") % 20 == 0), "embedding", 64.0).select(F.col("vec_id").alias("query_id"), F.col("_q").alias("q"))
    return search(index, queries, k=20)


QUERIES = {"op6_exact_topk": op6_exact_topk}
ORACLE_SQL = {
    "op6_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
}
