"""Near-duplicate documents by b-bit MinHash with exact confirmation.

1. Every whole text becomes its set of distinct five-word shingles (64-bit hashes) and a
   signature of 128 minima. Of each minimum the low 4 bits are kept, packed into eight longs.
2. Texts of equal sets collapse to one class; classes go on, copies do not.
3. 32 bands of 4 minima each give buckets. At similarity 0.80 a pair misses all bands with
   a chance below 1e-7. Each member meets the bucket's smallest member, so a bucket of n
   gives n - 1 pairs.
4. The packed bits estimate a pair's similarity, corrected for chance collisions; pairs more
   than six standard deviations below the threshold go, the rest are confirmed on full sets.
5. Links close to components. Buckets that still hold several components beyond the
   smallest member choose another member, by a hash, for all to meet, a few times over as long as
   that leaves clearly fewer members. What is left in several components then is compared in
   blocks, each pair in the first band that it shares, so that no link is missed for want of a
   link to a chosen member.

Defined cases: a text that is null or has no words has an empty set and is linked with
nothing; with fewer than five words the whole sequence is the one shingle; very long texts
are taken whole; repeated rows of a doc_id come back each, and where their texts differ
each row follows its own text; a null doc_id is linked with nothing and has a null component and is kept; other
columns pass through dedup(), whose own columns are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinloom.llm.common import SPACE_WORD, gram_hashes, in_bounded_batches, materialize, mix64, quoted, table, text_words
from clinloom.llm.components import connected_components

SHINGLE = 5
BANDS, ROWS = 32, 4
PERMS = BANDS * ROWS
BITS = 4
#: Six standard deviations of the estimate of a similarity of 0.80, and of 0.85.
SLACK = 0.23
#: Rounds in which each bucket's members meet one of them.
STARS = 4
#: No further round where one has left more than this share of the members: blocks come to them anyway.
STAR_LEAVES = 0.75
#: Members of a block in step 5, and shingles of its members, about.
BLOCK = 512
BLOCK_SHINGLES = 1 << 20

_RNG = np.random.default_rng(96)
_A = _RNG.integers(0, 2**63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, PERMS, dtype=np.uint64)


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """The sorted set of a text's shingles."""
    w = text_words(text, SPACE_WORD)
    if not len(w):
        return w
    return np.unique(gram_hashes(w, n) if len(w) >= n else gram_hashes(w, len(w), seed=len(w)))


def minima(s: np.ndarray) -> np.ndarray:
    out = np.full(PERMS, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 1024):
            np.minimum(out, (s[i : i + 1024, None] * _A + _B).min(axis=0), out=out)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.arange(BANDS, dtype=np.uint64) + np.uint64(77)
        for j in range(ROWS):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + m.reshape(BANDS, ROWS)[:, j])
    return h.view(np.int64)


def packed(m: np.ndarray) -> np.ndarray:
    """The low bits of all minima, 16 to a long."""
    low = (mix64(m) & np.uint64((1 << BITS) - 1)).reshape(-1, 64 // BITS)
    return (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).view(np.int64)


def set_key(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


_SIGN = "doc_id long, h long, n_shingles long, k1 long, k2 long, bands array<long>, bits array<long>"


def signatures(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, text). h, a hash of the text, tells rows of one doc_id apart."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])

    def run(batches):
        for b in in_bounded_batches(batches):
            rows = {k: [] for k in schema.names}
            for i, h, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(1)):
                s = shingles(t.as_py())
                k1, k2, bands, bits = 0, 0, None, None
                if len(s):
                    m = minima(s)
                    (k1, k2), bands, bits = set_key(s), band_keys(m), packed(m)
                for k, v in zip(schema.names, (i, h, len(s), k1, k2, bands, bits)):
                    rows[k].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h")).mapInArrow(run, _SIGN)


def estimate(a: list, b: list):
    """The collision-corrected similarity of two packed signatures, as a column."""
    lanes = 64 // BITS
    ones = int("1" * lanes, 16)
    wrong = None
    for x, y in zip(a, b):
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftright(d, 1))
        d = d.bitwiseOR(F.shiftright(d, 2))
        n = F.bit_count(d.bitwiseAND(F.lit(ones)))
        wrong = n if wrong is None else wrong + n
    by_chance = 2.0**-BITS
    return (1 - wrong / F.lit(float(PERMS)) - by_chance) / (1 - by_chance)


def _sets_of(docs: DataFrame, need: DataFrame) -> DataFrame:
    """(r, s) for the classes need (r, doc_id, k1, k2): their sets, from the texts of their smallest documents."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("s", pa.binary())])

    def run(batches):
        for b in in_bounded_batches(batches):
            got = [shingles(t.as_py()) for t in b.column(0)]
            keys = [set_key(s) for s in got]
            yield pa.RecordBatch.from_pydict({"k1": [k[0] for k in keys], "k2": [k[1] for k in keys], "s": [s.tobytes() for s in got]}, schema=schema)

    texts = docs.select(F.col("doc_id").cast("long"), "text").join(need.select("doc_id").distinct(), "doc_id", "left_semi").select("text")
    sets = texts.mapInArrow(run, "k1 long, k2 long, s binary")
    return sets.join(need.select("r", "k1", "k2"), ["k1", "k2"]).dropDuplicates(["r"]).select("r", "s")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those with 100 * intersection >= percent * union."""

    def run(batches):
        for batch in in_bounded_batches(batches, rows=512):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                u, v = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
                keep.append(_similar(u, v, percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_b = pairs.join(sets.select(F.col("r").alias("b"), F.col("s").alias("sb")), "b")
    with_both = with_b.join(sets.select(F.col("r").alias("a"), F.col("s").alias("sa")), "a")
    return with_both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _similar(u: np.ndarray, v: np.ndarray, percent: int) -> bool:
    both = np.intersect1d(u, v, assume_unique=True).size
    return 100 * both >= percent * (len(u) + len(v) - both)


def _mixed(members: DataFrame) -> DataFrame:
    """Members (key, r, c) of the buckets that hold several components."""
    keys = members.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where(F.col("lo") != F.col("hi")).select("key")
    return members.join(keys, "key", "left_semi")


class _Block:
    """Members of a bucket as arrays."""

    def __init__(self, members: pa.Array):
        f = dict(zip((x.name for x in members.type), members.flatten()))
        self.r, self.c = f["r"].to_numpy(), f["c"].to_numpy()
        self.bands = f["bands"].flatten().to_numpy().reshape(len(self.r), -1)
        self.bits = f["bits"].flatten().to_numpy().view(np.uint64).reshape(len(self.r), -1)
        self.sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in f["s"]]


def _links_between(x: _Block, y: _Block, key: int, percent: int) -> list[tuple[int, int]]:
    """Links that join components, of the members of x with those of y, which may be the same block."""
    ones, floor = np.uint64(int("1" * (64 // BITS), 16)), percent / 100 - SLACK
    names, comp = np.unique(np.concatenate([x.c, y.c]), return_inverse=True)
    root, xc, yc = np.arange(len(names)), comp[: len(x.c)], comp[len(x.c) :]
    out = []
    for i in range(len(x.r)):
        j = np.flatnonzero(root[yc] != root[xc[i]])
        if x is y:
            j = j[j > i]
        d = y.bits[j] ^ x.bits[i]
        d |= d >> np.uint64(1)
        d |= d >> np.uint64(2)
        est = (1 - np.bitwise_count(d & ones).sum(axis=1) / PERMS - 2.0**-BITS) / (1 - 2.0**-BITS)
        j, est = j[est >= floor], est[est >= floor]
        if len(j):  # in the first band that both share
            mine = x.bands[i][(y.bands[j] == x.bands[i]).argmax(axis=1)] == key
            j, est = j[mine], est[mine]
        for k in j[np.argsort(-est, kind="stable")]:
            if root[yc[k]] != root[xc[i]] and _similar(x.sets[i], y.sets[k], percent):
                root[root == root[yc[k]]] = root[xc[i]]
                out.append((min(x.r[i], y.r[k]), max(x.r[i], y.r[k])))
    return out


def _block_links(rest: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (a, b) between the components within the buckets of rest (key, r, c).

    A bucket's members stand in blocks, each member in one: the main component (that of the
    bucket's smallest member) apart from the others. Blocks of others meet the main
    component's blocks and one another, so a bucket of n members gives some (n / block)^2 pairs of
    blocks and never rows of pairs. Pairs in one component are not compared; a pair is
    compared in the first band that it shares.
    """
    main = rest.groupBy("key").agg(F.min(F.struct("r", "c")).alias("m")).select("key", F.col("m.c").alias("main"))
    data = rest.select("r").distinct().join(classes.select("r", "n_shingles", "bands", "bits"), "r").join(sets, "r")
    rows = rest.join(main, "key").select("key", "r", "c", (F.col("c") != F.col("main")).alias("out")).join(data, "r")
    rows = materialize(rows)
    blocks = lambda c: F.ceil(F.greatest(F.count_if(c) / F.lit(float(block)), F.sum(F.when(c, F.col("n_shingles")).otherwise(0)) / F.lit(float(BLOCK_SHINGLES)))).cast("int")
    size = materialize(rows.groupBy("key").agg(blocks(~F.col("out")).alias("n_in"), blocks(F.col("out")).alias("n_out")))
    dealt = rows.join(size, "key").withColumn("blk", F.pmod(F.xxhash64("r", F.lit(5)), F.when(F.col("out"), F.col("n_out")).otherwise(F.col("n_in"))).cast("int"))
    packed_ = materialize(dealt.groupBy("key", "out", "blk").agg(F.collect_list(F.struct("r", "c", "bands", "bits", "s")).alias("members")))  # one block
    # ids of blocks that meet: blocks of others (b1) with all of the main component's, and with those of others from themselves on
    upto = lambda lo, n: F.sequence(lo, n - 1)
    own = size.where(F.col("n_out") > 0).select("key", "n_in", "n_out", F.explode(upto(F.lit(0), F.col("n_out"))).alias("b1"))
    meet = F.concat(F.transform(upto(F.lit(0), F.col("n_in")), lambda k: F.struct(F.lit(False).alias("o2"), k.alias("b2"))), F.transform(upto(F.col("b1"), F.col("n_out")), lambda k: F.struct(F.lit(True).alias("o2"), k.alias("b2"))))
    meet = own.select("key", "b1", F.explode(meet).alias("m")).select("key", "b1", "m.*")
    left = packed_.where("out").select("key", F.col("blk").alias("b1"), F.col("members").alias("x"))
    right = packed_.select("key", F.col("out").alias("o2"), F.col("blk").alias("b2"), F.col("members").alias("y"))
    both = meet.join(left, ["key", "b1"]).join(right, ["key", "o2", "b2"])
    same = F.col("o2") & (F.col("b1") == F.col("b2"))
    both = both.select("key", "x", F.when(~same, F.col("y")).alias("y"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x = _Block(batch.column(1)[i].values)
                y = x if not batch.column(2)[i].is_valid else _Block(batch.column(2)[i].values)
                got = _links_between(x, y, batch.column(0)[i].as_py(), percent)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, stars: int = STARS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    return _judged(docs, percent, stars, block).drop("h")


def _judged(docs: DataFrame, percent: int, stars: int = STARS, block: int = BLOCK) -> DataFrame:
    """near_duplicates() with h, the hash of the row's text.

    A class has a number of its own, r, as texts of one doc_id may be in several classes; the
    written table keeps it.
    """
    floor = percent / 100 - SLACK
    signed = materialize(signatures(docs))
    whole = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    first = F.min(F.struct("doc_id", "n_shingles", "bands", "bits")).alias("m")
    classes = materialize(whole.groupBy("k1", "k2").agg(first).select("k1", "k2", "m.*", F.monotonically_increasing_id().alias("r")))

    members = classes.select("r", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("n"), F.min("r").alias("lead")).where(F.col("n") > 1)
    buckets = materialize(members.join(shared, "key"))
    bits = classes.select("r", *[F.col("bits")[k].alias(f"b{k}") for k in range(PERMS * BITS // 64)])
    side = {x: bits.select(F.col("r").alias(x), *[F.col(c).alias(x + c) for c in bits.columns[1:]]) for x in "ab"}
    est = estimate([F.col("a" + c) for c in bits.columns[1:]], [F.col("b" + c) for c in bits.columns[1:]])

    def likely(pairs: DataFrame) -> DataFrame:
        return materialize(pairs.distinct().join(side["a"], "a").join(side["b"], "b").where(est >= floor).select("a", "b"))

    pairs = likely(buckets.where(F.col("r") != F.col("lead")).select(F.col("lead").alias("a"), F.col("r").alias("b")))
    need = pairs.select(F.col("a").alias("r")).unionAll(pairs.select(F.col("b").alias("r"))).unionAll(buckets.where(F.col("n") > 2).select("r")).distinct()
    sets = materialize(_sets_of(docs, classes.select("r", "doc_id", "k1", "k2").join(need, "r", "left_semi")))
    links = materialize(confirm(pairs, sets, percent))
    labels = materialize(connected_components(links))
    # a smallest member has met all of its bucket
    rest = buckets.where((F.col("n") > 2) & (F.col("r") != F.col("lead"))).select("key", "r")

    def named(rows: DataFrame) -> DataFrame:
        rows = rows.select("key", "r").join(labels.withColumnRenamed("node", "r"), "r", "left")
        return materialize(_mixed(rows.select("key", "r", F.coalesce("component", "r").alias("c"))))

    def also(new: DataFrame) -> None:
        nonlocal links, labels
        new = materialize(new)
        if not new.isEmpty():
            links = materialize(links.unionAll(new))
            labels = materialize(connected_components(links))

    rest, before = named(rest), None
    for k in range(1, stars):
        n = rest.count()
        if not n or (before and n > STAR_LEAVES * before):
            break
        before = n
        lead = rest.groupBy("key").agg(F.min(F.struct(F.xxhash64("r", F.lit(k)).alias("h"), "r", "c")).alias("m")).select("key", F.col("m.r").alias("lead"), F.col("m.c").alias("lc"))
        met = rest.join(lead, "key").where(F.col("r") != F.col("lead"))
        also(confirm(likely(met.where(F.col("c") != F.col("lc")).select(F.least("lead", "r").alias("a"), F.greatest("lead", "r").alias("b"))), sets, percent))
        rest = named(met)
    if not rest.isEmpty():
        also(_block_links(rest, classes, sets, percent, block))

    known = classes.select("k1", "k2", "r", F.col("doc_id").alias("least"))
    linked = known.join(labels.withColumnRenamed("node", "r"), "r").select("k1", "k2", "component", "least")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = linked.join(least, "component").select("k1", "k2", "component_id")
    alone = known.join(labels.withColumnRenamed("node", "r"), "r", "left_anti").select("k1", "k2", F.col("least").alias("component_id"))
    out = signed.join(linked.unionAll(alone), ["k1", "k2"], "left")
    has_class = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    component = F.when(has_class, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "h", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def dedup(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: of each group those of the smallest doc_id, and all rows that are linked with nothing. Each row follows its own text."""
    gone = _judged(docs.select("doc_id", "text"), percent).where(~F.col("kept")).select("doc_id", "h").alias("g")
    kept = docs.alias("d").join(gone, (F.col("d.doc_id").cast("long") == F.col("g.doc_id")) & (F.xxhash64("d.text") == F.col("g.h")), "left_anti")
    return kept.select(*map(quoted, docs.columns))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest doc_id. Null and empty texts and null ids stay; each row follows its own text, so other texts under a doc_id that goes stay; columns are those of docs."""
    return dedup(docs, percent=80)


QUERIES = {"op4_minhash": op4_minhash}
#: Shingle sets and their similarity as such; components by closing links again and again.
ORACLE_SQL = {
    "op4_minhash": f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(w[i:i + {SHINGLE} - 1], ' '))) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS s FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.s = b.s AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT g.doc_id, CAST(len(g.g) AS BIGINT) AS n_shingles, least(g.doc_id, coalesce(c.m, g.doc_id)) AS component_id,
       g.doc_id = least(g.doc_id, coalesce(c.m, g.doc_id)) AS kept
FROM g LEFT JOIN c ON g.doc_id = c.a"""
}
