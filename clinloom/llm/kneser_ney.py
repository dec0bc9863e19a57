"""Quality by the perplexity of an interpolated modified Kneser-Ney model of trusted text.

Symbols are the bytes of a text as they are, the order is 6; an n-gram is its bytes in a
long. Count tables grow with the trusted text and are dealt into shards by the two bytes
before an n-gram's last one. So a shard holds, for orders 3 to 6, all n-grams of a context,
all that share a suffix, and the whole chain that an n-gram backs off along; only orders 1
and 2, whose tables the alphabet bounds, are summed over the shards and sent to all.

1. Trusted documents, some 16 MB at a time, send every shard their n-grams with counts, as
   packed sorted lists. Shards sum them, a bounded number of lists at a time; continuation counts,
   context totals and discounts follow.
2. All documents are dealt into buckets of some 16 MB. Each bucket asks every shard for its
   distinct n-grams; shards join these with their counts and answer with a probability each.
3. The answers go back to the buckets, and a document's perplexity is over all its bytes.

A fifth of the trusted documents, by a hash of doc_id, is kept out of training and sets the
thresholds: a language's is a quantile of the perplexities of its own such documents, taken
exactly on a scale of a thousandth of a bit; a language without any takes the quantile over
all languages.

Defined cases: texts that are null or empty have no perplexity and are not kept; very long
texts are scored whole; repeated rows are scored each, repeated labels count once; a null
doc_id is scored but never trusted; a null lang is a language of its own; with no trusted text
there is no threshold and everything with a text is kept; other columns are not returned.
"""

from __future__ import annotations

import gc
import time
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clinloom.llm.common import in_bounded_batches, materialize, mix64, table

ORDER = 6
#: Orders from here on live in shards; those below have at most 65,536 n-grams.
LOW = 3
SHARDS = 256
#: Characters of a bucket of documents, about.
BUCKET = 16 << 20
#: Lists that are summed at a time, and buckets that a shard answers at a time.
LISTS = 256
#: N-grams that wait to be merged, at least.
WAITING = 1 << 20
QUANTILE = 0.995
SCALE = 1000
#: Every text is preceded by line ends.
START = 10

# one byte a shard: numpy orders those by counting
_SHARD = (mix64(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)) % np.uint64(SHARDS)).astype(np.uint8)


def grams(text: str) -> np.ndarray:
    """The n-gram that ends at each byte of a text."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    s = np.full(len(data) + ORDER - 1, START, dtype=np.int64)
    s[ORDER - 1 :] = data
    g = np.zeros(len(data), dtype=np.int64)
    for k in range(ORDER):
        g = (g << 8) | s[k : k + len(data)]
    return g


def _last(g: np.ndarray, k: int) -> np.ndarray:
    return g & ((1 << (8 * k)) - 1)


def _packed(x: np.ndarray) -> bytes:
    """Numbers with their bytes laid side by side by rank, which packs well."""
    return zstandard.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), 1)


def _unpacked(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), dtype=np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _packed_sorted(g: np.ndarray) -> bytes:
    return _packed(np.diff(g, prepend=0))


def _unpacked_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(b, np.int64))


def _by_shard(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts sorted n-grams shard by shard, and where each shard begins and the last ends."""
    of = _SHARD[_last(g >> 8, 2)]
    return np.argsort(of, kind="stable"), np.r_[0, np.cumsum(np.bincount(of, minlength=SHARDS))]


def _add_up(g: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, sorted, with the sums of their counts."""
    order = np.argsort(g, kind="stable")
    g, c = g[order], c[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.empty(0, np.int64)
    return g[first], np.add.reduceat(c, first) if len(g) else c


class Model(NamedTuple):
    shards: DataFrame  # (shard, g, c): packed n-grams of the highest order with their counts
    low: np.ndarray  # probabilities of all n-grams of order LOW - 1
    discounts: dict[int, tuple[float, float, float]]


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """Of n-grams that occur once, twice and more often."""
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    bound = lambda d, k: min(max(d, 0.0), float(k))
    return bound(1 - 2 * y * n2 / n1, 1), bound(2 - 3 * y * n3 / n2, 2), bound(3 - 4 * y * n4 / n3, 3) if n3 else 1.5


class Table:
    """Of one order the seen n-grams with their own share, and the seen contexts with what they leave to the order below."""

    def __init__(self, g: np.ndarray, c: np.ndarray, d: tuple[float, float, float]):
        """g: sorted and distinct."""
        less = np.array(d)[np.minimum(c, 3) - 1]
        h = g >> 8
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
        total, left = (np.add.reduceat(x, first) if len(first) else np.empty(0) for x in (c, less))
        self.g, self.h = g, h[first]
        self.gamma = left / total
        self.own = (c - less) / np.repeat(total, np.diff(np.r_[first, len(g)]))

    def blend(self, q: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Probabilities of n-grams q, given those of their suffixes."""
        if not len(self.g):
            return below
        at = np.minimum(np.searchsorted(self.h, q >> 8), len(self.h) - 1)
        p = np.where(self.h[at] == q >> 8, self.gamma[at], 1.0) * below
        at = np.minimum(np.searchsorted(self.g, q), len(self.g) - 1)
        return p + np.where(self.g[at] == q, self.own[at], 0.0)


def _orders(g: np.ndarray, c: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """A shard's counts of the highest order, and below it numbers of different symbols before an n-gram."""
    out = {ORDER: (g, c)}
    for k in range(ORDER - 1, LOW - 1, -1):
        g, c = np.unique(_last(g, k), return_counts=True)
        out[k] = (g, c)
    return out


def _lists(bucket: int, g: np.ndarray, c: np.ndarray | None) -> pa.RecordBatch:
    """Sorted n-grams as a list for each shard, with their counts or without."""
    order, at = _by_shard(g)
    g, c = g[order], None if c is None else c[order]
    full = np.flatnonzero(np.diff(at)).tolist()
    cols = {"bucket": pa.array([bucket] * len(full), pa.int64()), "shard": pa.array(full, pa.int32()), "g": pa.array([_packed_sorted(g[at[k] : at[k + 1]]) for k in full], pa.binary())}
    if c is not None:
        cols["c"] = pa.array([_packed(c[at[k] : at[k + 1]]) for k in full], pa.binary())
    return pa.RecordBatch.from_pydict(cols)


def _texts(z: pa.ChunkedArray | pa.Array) -> list[str | None]:
    return [zstandard.decompress(x.as_buffer()).decode("utf-8", "surrogatepass") if x.is_valid else None for x in z]


def _only_distinct(lists: list[np.ndarray]) -> np.ndarray:
    """The distinct numbers of lists, sorted: a sort and a look at neighbours, as np.unique is several times slower here."""
    g = np.sort(np.concatenate(lists))
    return g[np.r_[True, g[1:] != g[:-1]]] if len(g) else g


def _distinct(batches) -> np.ndarray:
    """The distinct n-grams of compressed texts (z), sorted. Lists wait until they hold as much as is known, so none is sorted with every batch."""
    got, wait, have = np.empty(0, dtype=np.int64), [], 0
    for b in in_bounded_batches(batches, chars=1 << 20):
        found = [grams(t) for t in _texts(b.column("z")) if t]
        if found:
            wait.append(_only_distinct(found))
            have += len(wait[-1])
            if have > max(WAITING, len(got)):
                got, wait, have = _only_distinct([got, *wait]), [], 0
    return _only_distinct([got, *wait])


def _compressed(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep, of longs and strings, and the compressed text z."""
    rows = docs.select(*keep, "text")

    def run(batches):
        for b in in_bounded_batches(batches):
            z = [zstandard.compress(t.as_py().encode("utf-8", "surrogatepass"), 3) if t.is_valid else None for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(z, pa.binary())], names=[*keep, "z"])

    return rows.mapInArrow(run, ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep) + (", " if keep else "") + "z binary")


def count_lists(texts: DataFrame) -> DataFrame:
    """(bucket, shard, g, c): what every 16 MB of texts (z) sends to the shards."""

    def run(batches):
        part, size = TaskContext.get().partitionId(), 0
        g, n = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        for b in in_bounded_batches(batches, chars=1 << 20):
            found = [grams(t) for t in _texts(b.column("z")) if t]
            if not found:
                continue
            x, c = np.unique(np.concatenate(found), return_counts=True)
            g, n = _add_up(np.concatenate([g, x]), np.concatenate([n, c]))
            size += sum(map(len, found))
            if size >= BUCKET:
                yield _lists(part, g, n)
                g, n, size = g[:0], n[:0], 0
        yield _lists(part, g, n)

    return texts.select("z").mapInArrow(run, "bucket long, shard int, g binary, c binary")


def _summed(lists: DataFrame) -> DataFrame:
    """(shard, g, c): one list a shard, from the lists (bucket, shard, g, c)."""

    def run(t: pa.Table) -> pa.Table:
        g, c = _add_up(np.concatenate([_unpacked_sorted(x.as_py()) for x in t["g"]]), np.concatenate([_unpacked(x.as_py(), np.int64) for x in t["c"]]))
        return pa.table({"bucket": t["bucket"][:1], "shard": t["shard"][:1], "g": pa.array([_packed_sorted(g)], pa.binary()), "c": pa.array([_packed(c)], pa.binary())})

    buckets = (lists.agg(F.max("bucket")).first()[0] or 0) + 1
    while True:
        lists = materialize(lists.withColumn("bucket", F.expr(f"bucket div {LISTS}")).groupBy("shard", "bucket").applyInArrow(run, lists.schema))
        if buckets <= LISTS:
            return lists.drop("bucket")
        buckets = -(-buckets // LISTS)


def fit(lists: DataFrame) -> Model:
    """The model of count_lists(), which are read twice."""
    shards = _summed(lists)

    def look(batches):
        """Numbers of n-grams by order and count, and each shard's part of the counts of order LOW - 1."""
        for b in batches:
            for g, c in zip(b.column("g"), b.column("c")):
                rows: list[tuple[int, int, int]] = []
                orders = _orders(_unpacked_sorted(g.as_py()), _unpacked(c.as_py(), np.int64))
                for k, (_, n) in orders.items():
                    rows += [(k, j, int((n == j).sum())) for j in (1, 2, 3, 4)]
                x, n = np.unique(_last(orders[LOW][0], LOW - 1), return_counts=True)
                rows += [(LOW - 1, i, j) for i, j in zip(x.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], names=["k", "x", "n"])

    # at most 65,536 rows, by the alphabet
    seen = {(r.k, r.x): r.n for r in shards.mapInArrow(look, "k long, x long, n long").groupBy("k", "x").agg(F.sum("n").alias("n")).collect()}
    found = {k: discounts(*(float(seen.get((k, j), 0)) for j in (1, 2, 3, 4))) for k in range(LOW, ORDER + 1)}
    g = np.array(sorted(x for k, x in seen if k == LOW - 1), dtype=np.int64)
    c = np.array([seen[LOW - 1, x] for x in g.tolist()], dtype=np.int64)
    low = np.full(1, 1 / 256)
    tables = [(g, c)]
    for k in range(LOW - 2, 0, -1):
        tables.insert(0, np.unique(_last(tables[0][0], k), return_counts=True))
    for k, (g, c) in enumerate(tables, 1):
        every = np.arange(256**k)
        low = Table(g, c, discounts(*(float((c == j).sum()) for j in (1, 2, 3, 4)))).blend(every, low[_last(every, k - 1)])
    return Model(shards, low, found)


def train(texts: DataFrame) -> Model:
    """The model of texts (text)."""
    return fit(materialize(count_lists(_compressed(texts))))


def answers(asked: DataFrame, model: Model, buckets: int) -> DataFrame:
    """(bucket, shard, bits): packed bits of each n-gram asked for, in its list's order. asked: (bucket, shard, g).

    A shard's counts meet the lists of LISTS buckets at a time, so they are copied once for as many buckets.
    """
    groups = F.expr(f"bucket div {LISTS}")
    low = asked.sparkSession.sparkContext.broadcast(model.low)  # 65,536 numbers
    found = model.discounts

    def run(key, lists: pa.Table, counts: pa.Table) -> pa.Table:
        tables = []
        if counts.num_rows:
            orders = _orders(_unpacked_sorted(counts["g"][0].as_py()), _unpacked(counts["c"][0].as_py(), np.int64))
            tables = [(k, Table(*orders[k], found[k])) for k in range(LOW, ORDER + 1)]
        out = []
        for x in lists["g"]:
            q = _unpacked_sorted(x.as_py())
            p = low.value[_last(q, LOW - 1)]
            for k, t in tables:
                p = t.blend(_last(q, k), p)
            out.append(_packed(-np.log2(np.maximum(p, 1e-12)).astype(np.float32)))
        return pa.table({"bucket": lists["bucket"], "shard": lists["shard"], "bits": pa.array(out, pa.binary())})

    copies = model.shards.withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((buckets - 1) // LISTS).cast("long"))))
    return asked.select("shard", groups.alias("grp"), "bucket", "g").groupBy("shard", "grp").cogroup(copies.groupBy("shard", "grp")).applyInArrow(run, "bucket long, shard int, bits binary")


def _looked_up(flat: np.ndarray, g: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Bits of n-grams, all of which are in g; each distinct one of 65,536 in a row is searched for once, in order."""
    value = np.empty(len(flat))
    for lo in range(0, len(flat), 1 << 16):
        q = flat[lo : lo + (1 << 16)].astype(np.uint64)
        # the place below the six bytes: numpy sorts numbers much faster than it orders them
        q = np.sort((q << np.uint64(16)) | np.arange(len(q), dtype=np.uint64))
        place, q = (q & np.uint64(0xFFFF)).astype(np.int64), (q >> np.uint64(16)).astype(np.int64)
        new = np.r_[True, q[1:] != q[:-1]]
        value[lo + place] = bits[np.searchsorted(g, q[new])][np.cumsum(new) - 1]
    return value


def _answered(docs: pa.Table, got: pa.Table) -> pa.Table:
    """A bucket's documents with their bits a byte."""
    g = _distinct(docs.to_batches())
    order, _ = _by_shard(g)
    lists = sorted(zip(got["shard"].to_pylist(), got["bits"]), key=lambda x: x[0])
    bits = np.empty(len(g))
    bits[order] = np.concatenate([_unpacked(x.as_py(), np.float32) for _, x in lists]) if lists else np.empty(0)
    n, mean = [], []
    batches = list(in_bounded_batches(docs.to_batches(), chars=1 << 20))
    for b in batches:
        found = [grams(t or "") for t in _texts(b.column("z"))]
        flat = np.concatenate(found)
        value = _looked_up(flat, g, bits)
        end = 0
        for x in found:
            start, end = end, end + len(x)
            n.append(len(x))
            mean.append(float(value[start:end].sum()) / len(x) if len(x) else None)
    kept = pa.Table.from_batches(batches, docs.schema)
    return pa.table({"doc_id": kept["doc_id"], "lang": kept["lang"], "n_bytes": pa.array(n, pa.int64()), "bits": pa.array(mean, pa.float64())})


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, n_bytes, bits): bits a byte, null without text. docs: (doc_id, lang, text)."""
    buckets = (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // BUCKET + 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    rows = _compressed(rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets))), "doc_id", "lang", "bucket")

    def ask(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_lists(t["bucket"][0].as_py(), _distinct(t.to_batches()), None)])

    # both uses of the dealt rows share one exchange
    by_bucket = rows.groupBy("bucket")
    asked = by_bucket.applyInArrow(ask, "bucket long, shard int, g binary")
    return by_bucket.cogroup(answers(asked, model, buckets).groupBy("bucket")).applyInArrow(_answered, "doc_id long, lang string, n_bytes long, bits double")


def _release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of what was materialized, which hold texts; it does so a little later."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.7)


def thresholds(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(whole, lang, level): by language the least level at or under which that share of its documents marked trusted lies; whole: over all languages."""
    level = F.ceil(F.col("bits") * SCALE).cast("long")
    counts = scored.where(F.col("trusted") & F.col("bits").isNotNull()).groupBy(F.lit(False).alias("whole"), "lang", level.alias("level")).agg(F.count("*").alias("n"))
    counts = counts.unionAll(counts.groupBy(F.lit(True).alias("whole"), F.lit(None).cast("string").alias("lang"), "level").agg(F.sum("n").alias("n")))
    w = Window.partitionBy("whole", "lang")  # levels of a language, not its documents: at most some 40,000
    run = counts.select("whole", "lang", "level", F.sum("n").over(w.orderBy("level")).alias("upto"), F.sum("n").over(w).alias("all"))
    return run.where(F.col("upto") >= F.col("all") * quantile).groupBy("whole", "lang").agg(F.min("level").alias("level"))


def quality(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold, kept for every row of docs. trusted: (doc_id)."""
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct()
    # trusted ids grow with the corpus, so both sides are always dealt by doc_id and the plan is alike at every size
    out_of_five = F.pmod(F.xxhash64("doc_id"), F.lit(5))
    learn, judge = ids.where(out_of_five > 0), ids.where(out_of_five == 0)
    texts = _compressed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull()), "doc_id")
    lists = materialize(count_lists(texts.join(learn.hint("merge"), "doc_id", "left_semi")))
    _release(docs.sparkSession)
    scored = materialize(score(docs, fit(lists)))
    scored = scored.join(judge.withColumn("trusted", F.lit(True)), "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    cut = thresholds(scored, quantile)
    own = cut.where(~F.col("whole")).select(F.col("lang").alias("l"), "level")
    everyone = cut.where("whole").agg(F.max("level").alias("common"))
    # languages, and one row: both small
    out = scored.join(own, F.col("lang").eqNullSafe(F.col("l")), "left").join(everyone, F.lit(True), "left")
    top = F.pow(F.lit(2.0), F.coalesce("level", "common") / SCALE)
    out = out.select("doc_id", "lang", "n_bytes", F.pow(F.lit(2.0), "bits").alias("perplexity"), top.alias("threshold"))
    return out.withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.col("perplexity").isNotNull() & F.col("threshold").isNull()))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where(F.col("quality") == 1)
    return quality(table(spark, sf_dir, "documents"), trusted)


QUERIES = {"op10_quality": op10_quality}
ORACLE_SQL: dict[str, str] = {}
