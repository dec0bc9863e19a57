"""Benchmark decontamination over a distributed positional inverted index.

Index: every shard of documents stores, for each of its terms (64-bit hashes of words),
the ascending list of places where it occurs. Search: a phrase's rarest term gives the
possible starts; the other terms' lists, each shifted by the term's place in the phrase,
are intersected with them from the rarest on. What stays is an exact phrase match; with a
slop the terms need only follow one another within that many words more.

Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z. An
item's windows are all its runs of 13 words, or its whole text if shorter. A document is
contaminated if the words inside occurrences of windows are a twentieth of it or more.

Defined cases: null text has no words and is clean; an item without words has no windows;
very long documents fill a shard; repeated rows are judged each, also under one doc_id; a
null doc_id is carried along, and its row goes if it is contaminated; a null item_id's windows hit words but are named in no item list; an empty
benchmark leaves all clean; other columns of documents pass through decontaminate().
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinloom.llm.common import ALNUM_WORD, LOWER, UPPER, in_bounded_batches, materialize, table, text_words

WINDOW = 13
SHARE = 20
SHARD_WORDS = 1 << 20
#: Characters of benchmark text in one broadcast block of windows, about; more text takes more blocks.
BLOCK_CHARS = 4 << 20

_INDEX = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("docs", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("sizes", pa.binary()), ("terms", pa.binary()), ("offsets", pa.binary()), ("postings", pa.binary())])
_INDEX_DDL = "part int, seq int, docs array<long>, keys array<long>, sizes binary, terms binary, offsets binary, postings binary"


def build_index(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row a shard. docs: (doc_id, text). keys are hashes of the texts, which tell rows of one doc_id apart."""

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        ids: list = []
        keys: list = []
        words: list[np.ndarray] = []

        def close():
            nonlocal seq, ids, keys, words
            w = np.concatenate(words) if words else np.empty(0, np.uint64)
            order = np.argsort(w, kind="stable").astype("<u4")
            s = w[order]
            first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.empty(0, np.int64)
            row = {"part": [part], "seq": [seq], "docs": [ids], "keys": [keys], "sizes": [np.array([len(x) for x in words], dtype="<i8").tobytes()], "terms": [s[first].astype("<u8").tobytes()], "offsets": [np.r_[first, len(s)].astype("<u4").tobytes()], "postings": [order.tobytes()]}
            seq, ids, keys, words = seq + 1, [], [], []
            return pa.RecordBatch.from_pydict(row, schema=_INDEX)

        have = 0
        for b in in_bounded_batches(batches):
            for i, t, k in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                w = text_words(t.as_py(), ALNUM_WORD)
                ids.append(i)
                keys.append(k)
                words.append(w)
                have += len(w)
                if have >= shard_words:
                    yield close()
                    have = 0
        if ids:
            yield close()

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")).mapInArrow(run, _INDEX_DDL)


class Shard:
    """Lists of places by term; places count through all documents of the shard."""

    def __init__(self, docs: list, sizes: bytes, terms: bytes, offsets: bytes, postings: bytes):
        self.docs, self.sizes = docs, np.frombuffer(sizes, dtype="<i8")
        self.ends = np.cumsum(self.sizes)
        self.terms, self.offsets, self.postings = np.frombuffer(terms, dtype="<u8"), np.frombuffer(offsets, dtype="<u4").astype(np.int64), np.frombuffer(postings, dtype="<u4")

    def find(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each term its place in the term list and its number of occurrences, 0 if it is missing."""
        if not len(self.terms):
            return np.zeros(terms.shape, np.int64), np.zeros(terms.shape, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return at, np.where(self.terms[at] == terms, self.offsets[at + 1] - self.offsets[at], 0)

    def places(self, at: int) -> np.ndarray:
        return self.postings[self.offsets[at] : self.offsets[at + 1]].astype(np.int64)

    def _within(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Which spans lie in one document."""
        return np.searchsorted(self.ends, first, side="right") == np.searchsorted(self.ends, last, side="right")

    def phrase(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Starts of exact occurrences of a phrase, given its terms as find() returns them."""
        if not len(at) or not count.all():
            return np.empty(0, np.int64)
        order = np.argsort(count, kind="stable")
        start = self.places(at[order[0]]) - order[0]
        start = start[start >= 0]
        for j in order[1:]:
            if not len(start):
                break
            p, want = self.places(at[j]), start + j
            k = np.minimum(np.searchsorted(p, want), len(p) - 1)
            start = start[p[k] == want]
        return start[self._within(start, start + len(at) - 1)]

    def proximity(self, terms: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last places where the terms follow one another with at most slop other words between them."""
        at, count = self.find(terms)
        if not len(at) or not count.all():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        first = last = self.places(at[0])
        for j in range(1, len(at)):
            p = self.places(at[j])
            k = np.searchsorted(p, last, side="right")
            first, last = first[k < len(p)], p[k[k < len(p)]]
        ok = (last - first < len(at) + slop) & self._within(first, last)
        return first[ok], last[ok]


def windows_of(text: str | None, n: int = WINDOW) -> list[np.ndarray]:
    w = text_words(text, ALNUM_WORD)
    if not len(w):
        return []
    return [w] if len(w) <= n else list(np.lib.stride_tricks.sliding_window_view(w, n))


def _blocks(benchmark: DataFrame, window: int, block_chars: int) -> list:
    """Broadcasts of windows: by length a matrix of terms and the items of each row. Each block of items has about block_chars of text, so each is bounded."""
    items = benchmark.select(F.col("item_id").cast("string"), "text").where(F.col("text").isNotNull())
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // block_chars))
    out = []
    for k in range(n):
        by: dict[int, dict[bytes, set]] = {}
        for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect():
            for w in windows_of(r["text"], window):
                by.setdefault(len(w), {}).setdefault(w.tobytes(), set()).add(r["item_id"])
        block = [(np.frombuffer(b"".join(d), dtype=np.uint64).reshape(-1, size), [sorted(x - {None}) for x in d.values()]) for size, d in sorted(by.items())]
        out.append(benchmark.sparkSession.sparkContext.broadcast(block))
    return out


_HITS = "part int, seq int, nth int, doc_id long, text_key long, n_words long, spans array<array<long>>, items array<string>"


def _matches(index: DataFrame, block, every: bool) -> DataFrame:
    """By document the merged spans that are hit and the items that hit; with every, also documents without any."""
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("nth", pa.int32()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                s = Shard(row["docs"], row["sizes"], row["terms"], row["offsets"], row["postings"])
                step = np.zeros(int(s.sizes.sum()) + 1, dtype=np.int64)
                items: dict[int, set] = {}
                for terms, names in block.value:
                    at, count = s.find(terms)
                    for k in np.flatnonzero(count.all(axis=1)):
                        start = s.phrase(at[k], count[k])
                        np.add.at(step, start, 1)
                        np.add.at(step, start + terms.shape[1], -1)
                        for d in np.unique(np.searchsorted(s.ends, start, side="right")).tolist():
                            items.setdefault(d, set()).update(names[k])
                flag = np.r_[0, (np.cumsum(step[:-1]) > 0).astype(np.int8), 0]
                # spans do not reach over the border of two documents
                up, down = np.flatnonzero(np.diff(flag) == 1), np.flatnonzero(np.diff(flag) == -1)
                begin = s.ends - s.sizes
                out = []
                for d in range(len(s.docs)) if every else sorted(items):
                    spans = []
                    if d in items:
                        lo, hi = begin[d], s.ends[d]
                        for i in range(int(np.searchsorted(down, lo, side="right")), int(np.searchsorted(up, hi, side="left"))):
                            spans.append([int(max(up[i], lo) - lo), int(min(down[i], hi) - lo)])
                    out.append({"part": row["part"], "seq": row["seq"], "nth": d, "doc_id": s.docs[d], "text_key": row["keys"][d], "n_words": int(s.sizes[d]), "spans": spans, "items": sorted(items.get(d, ()))})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    return index.mapInArrow(run, _HITS)


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """For every indexed document: doc_id, text_key, n_words, spans [[first, end)] of hit words, item_ids (sorted)."""
    blocks = _blocks(benchmark, window, block_chars)
    found = reduce(DataFrame.unionAll, [_matches(index, b, k == 0) for k, b in enumerate(blocks)])
    if len(blocks) == 1:
        return found.select("doc_id", "text_key", "n_words", "spans", F.col("items").alias("item_ids"))
    merged = found.groupBy("part", "seq", "nth").agg(F.first("doc_id").alias("doc_id"), F.first("text_key").alias("text_key"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("item_ids"))
    # overlapping spans of several blocks become one
    def join(acc, x):
        open_ = (F.size(acc) > 0) & (F.element_at(F.try_element_at(acc, F.lit(-1)), 2) >= x[0])
        last = F.try_element_at(acc, F.lit(-1))
        both = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.array(last[0], F.greatest(last[1], x[1]))))
        return F.when(open_, both).otherwise(F.concat(acc, F.array(x)))

    return merged.select("doc_id", "text_key", "n_words", F.aggregate("spans", F.array().cast("array<array<bigint>>"), join).alias("spans"), "item_ids")


def judge(found: DataFrame, share: int = SHARE, *more: str) -> DataFrame:
    """The verdicts on what search() found; more: further columns of it to return."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x[1] - x[0])
    out = found.select("doc_id", *more, "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The verdict on every row of docs; the index is stored in the shared folder first."""
    return judge(search(materialize(build_index(docs)), benchmark))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated. A verdict follows its row: rows of one doc_id, or of none, are told apart by their texts."""
    found = search(materialize(build_index(docs.select("doc_id", "text"))), benchmark)
    bad = judge(found, SHARE, "text_key").where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_key"])
    return docs.join(bad, same, "left_anti")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not contaminated. Null and empty texts stay; each row follows its own verdict; an empty benchmark keeps all; columns are those of docs."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


QUERIES = {"op7_decontamination": op7_decontamination}


def _words(name: str) -> str:
    return f"regexp_extract_all(translate(coalesce({name}.text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


ORACLE_SQL = {
    "op7_decontamination": f"""
WITH d AS (SELECT doc_id, {_words('documents')} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_words('benchmark')} AS w FROM benchmark),
v AS (SELECT item_id, least({WINDOW}, len(w)) AS n, w, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS k FROM i WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM v),
n AS (SELECT DISTINCT n FROM q),
g AS (SELECT doc_id, n.n, w, unnest(range(1, len(w) - n.n + 2)) AS k FROM d, n WHERE len(w) >= n.n),
h AS (SELECT doc_id, k, g.n, item_id FROM g JOIN q ON g.n = q.n AND array_to_string(g.w[k:k + g.n - 1], ' ') = q.s),
t AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN m ON d.doc_id = m.doc_id"""
}
