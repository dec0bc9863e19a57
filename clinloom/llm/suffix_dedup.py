"""Passages that repeat across documents, by a sparse suffix array.

Of all suffixes (a document's words from some place on) only those stay that begin at a
minimiser: the smallest five-word hash of 26 in a row. Any passage of 50 words holds one
in its first 26 places, so at least 25 words of the passage follow it, and two copies
of a passage keep the same one.

1. The sparse suffixes are dealt and sorted by the hash of their first 25 words, then by the hash of
   all words within reach (25 to the left, 50 to the right). Those that nobody shares the first 25 words with go.
   Equal neighbours of different documents repeat within that whole reach; two of them stand for all.
2. What shares the first 25 words but not the whole reach is sorted by its words (as 64-bit codes)
   in ranges over all tasks. Neighbours are compared word by word, which tells how far each match
   goes to the right; ordered by the words before them, how far to the left. Each suffix gets the
   first and last word that passages of 50 words shared with another document reach.
3. A task cannot see the neighbours beyond its first and last 25 words in common, nor does it hold more than
   CHUNK rows of one beginning at a time. The passages over these suffixes are compared by hash.
4. A document's matches merge into maximal spans.

Every passage of 50 words that two documents share is found, and nothing else. Words are
runs without white space, A-Z lower-cased.

Defined cases: texts that are null or have fewer words than a passage have no spans; very
long texts are taken whole; rows that repeat in doc_id are one document, whose passages
repeat only if another document has them; a null doc_id counts as one more document; an
empty table gives an empty result; other columns are not returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinloom.llm.common import _BASE, SPACE_WORD, gram_hashes, in_bounded_batches, materialize, mix64, table, text_words

PASSAGE = 50
GRAM = 5
REACH = PASSAGE // 2
#: Suffixes that a task holds at a time.
CHUNK = 1 << 15
_NULL = -(2**63)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """A text's words, with the hash of any run of them in constant time."""

    def __init__(self, text: str | None):
        self.w = text_words(text, SPACE_WORD)
        n = len(self.w)
        with np.errstate(over="ignore"):
            up = np.full(n + 1, _BASE, dtype=np.uint64)
            up[0] = 1
            up = np.multiply.accumulate(up)
            down = np.full(n + 1, pow(_BASE, -1, 2**64), dtype=np.uint64)
            down[0] = 1
            self.down = np.multiply.accumulate(down)
            self.sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(self.w * up[:n], out=self.sums[1:])

    def __len__(self) -> int:
        return len(self.w)

    def runs(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[hi] - self.sums[lo]) * self.down[lo] + (hi - lo).astype(np.uint64) * _GOLD)

    def anchors(self, passage: int) -> np.ndarray:
        """For each place where a passage can begin, the place of its minimiser."""
        n, reach = len(self.w) - passage + 1, passage // 2
        if n <= 0:
            return np.empty(0, dtype=np.int64)
        h = gram_hashes(self.w, GRAM)[: n + reach]
        out = np.empty(n, dtype=np.int64)
        for i in range(0, n, 1 << 16):
            part = h[i : i + (1 << 16) + reach]
            out[i : i + (1 << 16)] = np.lib.stride_tricks.sliding_window_view(part, reach + 1).argmin(axis=1)[: n - i] + np.arange(i, min(n, i + (1 << 16)))
        return out


def sparse_suffixes(docs: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """(key, ctx, doc, pos, left, right): sparse suffixes with their first words' hash and that of all words within reach."""
    names = ["key", "ctx", "doc", "pos", "left", "right"]
    reach = passage // 2

    def run(batches):
        for b in in_bounded_batches(batches):
            cols: list[list[np.ndarray]] = [[] for _ in names]
            for doc, t in zip(b.column(0).to_pylist(), b.column(1)):
                w = Words(t.as_py())
                at = np.unique(w.anchors(passage))
                if not len(at):
                    continue
                lo, hi = np.maximum(at - reach, 0), np.minimum(at + passage, len(w))
                with np.errstate(over="ignore"):
                    ctx = mix64(w.runs(lo, hi) + (at - lo).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
                for c, v in zip(cols, (w.runs(at, at + reach).view(np.int64), ctx.view(np.int64), np.full(len(at), _NULL if doc is None else doc), at, at - lo, hi - at)):
                    c.append(v)
            if cols[0]:
                arrays = [np.concatenate(c) for c in cols]
                yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32) if n in ("pos", "left", "right") else a) for n, a in zip(names, arrays)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "key long, ctx long, doc long, pos int, left int, right int")


def _run_ends(same: np.ndarray) -> np.ndarray:
    """First places of runs; same: whether each entry but the first equals the one before."""
    return np.flatnonzero(np.r_[True, ~same])


def _chunks(batches, head: Callable[[pa.Table], np.ndarray], rows: int) -> Iterator[tuple[pa.Table, bool, bool]]:
    """Sorted rows in pieces of some size, cut between beginnings (equal entries of head) where there is a place to cut.

    With each piece whether its first and its last beginning may go on outside it.
    """
    held: list[pa.RecordBatch] = []
    count, started, cut = 0, False, False  # cut: the piece before ended between two beginnings
    for b in batches:
        held.append(b)
        count += b.num_rows
        if count < 2 * rows:
            continue
        t = pa.Table.from_batches(held)
        h = head(t)
        ends = np.flatnonzero(h[1:] != h[:-1]) + 1
        at = int(ends[-1]) if len(ends) else len(h)
        yield t.slice(0, at), not (started and cut), not len(ends)
        started, cut = True, bool(len(ends))
        held = t.slice(at).to_batches()
        count = len(h) - at
    if count:
        yield pa.Table.from_batches(held), not (started and cut), True


def compare_neighbours(suffixes: DataFrame, passage: int = PASSAGE, chunk: int = CHUNK) -> DataFrame:
    """(doc, pos, lo, hi): with hi > lo words that repeat; with hi null a suffix that shares its first words, but not its reach."""
    order = ["key", "ctx", "doc", "pos"]
    ranged = suffixes.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        for t, open_start, open_end in _chunks((b for b in batches if b.num_rows), lambda t: t["key"].to_numpy(), 8 * chunk):
            key, ctx, doc, pos, left, right = (t[c].to_numpy() for c in ("key", "ctx", "doc", "pos", "left", "right"))
            n = len(key)
            by_key = np.r_[_run_ends(key[1:] == key[:-1]), n]
            by_ctx = np.r_[_run_ends((key[1:] == key[:-1]) & (ctx[1:] == ctx[:-1])), n]
            group = np.searchsorted(by_key, by_ctx[:-1], side="right") - 1  # a reach's key
            parts = np.bincount(group, minlength=len(by_key) - 1)
            # sorted by document within a run, so its ends tell whether it has several
            several = doc[by_ctx[:-1]] != doc[by_ctx[1:] - 1]
            edge = (open_start & (group == 0)) | (open_end & (group == len(by_key) - 2))
            on = (parts[group] > 1) | edge
            size = np.diff(by_ctx)
            full = np.repeat(several, size) & (left + right >= passage)
            lo, hi = (pos - left)[full], (pos + right)[full]
            # a run of several documents repeats wholly: two entries, of its first and last document, stand for it
            ask = np.unique(np.r_[by_ctx[:-1][on & several], (by_ctx[1:] - 1)[on & several], np.flatnonzero(np.repeat(on & ~several, size))])
            yield pa.RecordBatch.from_arrays([pa.array(doc[full]), pa.array(pos[full]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["doc", "pos", "lo", "hi"])
            yield pa.RecordBatch.from_arrays([pa.array(doc[ask]), pa.array(pos[ask]), pa.array(np.zeros(len(ask), np.int32)), pa.nulls(len(ask), pa.int32())], names=["doc", "pos", "lo", "hi"])

    return ranged.mapInArrow(run, "doc long, pos int, lo int, hi int")


def _places(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc, text, places): texts that hold suffixes asked for."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc"), "text")
    return texts.join(asked.groupBy("doc").agg(F.collect_set("pos").alias("places")), "doc").select("doc", "text", "places")


def _coded(words: np.ndarray, at: np.ndarray) -> pa.Array:
    """The words at these places, 0 beyond the text, as bytes that sort like the words' codes."""
    codes = np.where((at >= 0) & (at < len(words)), words[np.clip(at, 0, len(words) - 1)], 0).astype(">u8")
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * at.shape[1]), len(at), [None, pa.py_buffer(codes.tobytes())]).cast(pa.binary())


def suffix_words(docs: DataFrame, asked: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """(after, before, doc, pos, left, right): the words from a suffix's place on, and those before it, the nearest first."""
    reach = passage // 2

    def run(batches):
        for b in in_bounded_batches(batches):
            for doc, t, places in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                w = Words(t.as_py())
                every = np.sort(places.values.to_numpy())
                every = every[every < len(w)].astype(np.int64)
                for i in range(0, len(every), 4096):
                    at = every[i : i + 4096]
                    after, before = _coded(w.w, at[:, None] + np.arange(passage)), _coded(w.w, at[:, None] - 1 - np.arange(reach))
                    ints = [pa.array(v.astype(np.int32)) for v in (at, np.minimum(at, reach), np.minimum(len(w) - at, passage))]
                    yield pa.RecordBatch.from_arrays([after, before, pa.array(np.full(len(at), doc)), *ints], names=["after", "before", "doc", "pos", "left", "right"])

    return _places(docs, asked).mapInArrow(run, "after binary, before binary, doc long, pos int, left int, right int")


def _codes(t: pa.Table, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(t[name].to_pylist()), dtype=">u8").reshape(t.num_rows, -1)


def _common(a: np.ndarray, length: np.ndarray) -> np.ndarray:
    """How many words each row has in common with the one before, within the lengths of both; 0 for the first."""
    out = np.zeros(len(a), dtype=np.int64)
    other = a[1:] != a[:-1]
    out[1:] = np.where(other.any(axis=1), other.argmax(axis=1), a.shape[1])
    out[1:] = np.minimum(out[1:], np.minimum(length[1:], length[:-1]))
    return out


def extend_matches(after: np.ndarray, before: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes sorted by `after`: how many words to the left passages shared with another document begin, at most and at least (-1: none is).

    A passage that begins l words to the left is shared by suffixes that have passage - l words after and
    l words before in common: runs of neighbours in one order that are in one run of the other order too.
    """
    n = len(doc)
    to_right = _common(after, right)
    order = np.argsort(np.ascontiguousarray(before).view(f"S{8 * before.shape[1]}").ravel(), kind="stable")
    to_left = _common(before[order], left[order])
    most, least = np.full(n, -1), np.full(n, -1)
    same_left = np.empty(n, dtype=np.int64)
    for step in range(passage // 2 + 1):
        same_left[order] = np.cumsum(to_left < step)
        rows = np.flatnonzero((left >= step) & (right >= passage - step))
        if not len(rows):
            continue
        both = np.cumsum(to_right < passage - step)[rows] * (n + 1) + same_left[rows]
        by = np.lexsort((doc[rows], both))
        rows, both = rows[by], both[by]
        ends = np.r_[_run_ends(both[1:] == both[:-1]), len(rows)]
        several = doc[rows[ends[:-1]]] != doc[rows[ends[1:] - 1]]
        hit = rows[np.repeat(several, np.diff(ends))]
        most[hit] = step
        least[hit] = np.where(least[hit] < 0, step, least[hit])
    return most, least


def compare_words(words: DataFrame, passage: int = PASSAGE, chunk: int = CHUNK) -> DataFrame:
    """(doc, pos, lo, hi): as compare_neighbours, by the words themselves; hi is null where neighbours may be out of sight."""
    ranged = words.repartitionByRange("after", "doc", "pos").sortWithinPartitions("after")
    head = 8 * (passage // 2)

    def first_words(t: pa.Table) -> np.ndarray:
        return np.array([v[:head] for v in t["after"].to_pylist()], dtype=f"S{head}")

    def run(batches):
        for t, open_start, open_end in _chunks((b for b in batches if b.num_rows), first_words, chunk):
            h = first_words(t)
            doc, pos, left, right = (t[c].to_numpy() for c in ("doc", "pos", "left", "right"))
            outside = (open_start & (h == h[0])) | (open_end & (h == h[-1]))
            most, least = extend_matches(_codes(t, "after"), _codes(t, "before"), doc, left, right, passage)
            hit = most >= 0
            lo, hi = (pos - most)[hit], (pos - least + passage)[hit]
            yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(pos[hit]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["doc", "pos", "lo", "hi"])
            if outside.any():
                yield pa.RecordBatch.from_arrays([pa.array(doc[outside]), pa.array(pos[outside]), pa.array(np.zeros(outside.sum(), np.int32)), pa.nulls(int(outside.sum()), pa.int32())], names=["doc", "pos", "lo", "hi"])

    return ranged.mapInArrow(run, "doc long, pos int, lo int, hi int")


def _passages(docs: DataFrame, asked: DataFrame, passage: int) -> DataFrame:
    """(h, doc, at): hashes of the passages that lie over the suffixes asked for."""
    rows = _places(docs, asked)

    def run(batches):
        for b in in_bounded_batches(batches):
            out: list[list[np.ndarray]] = [[], [], []]
            for doc, t, places in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                w = Words(t.as_py())
                at = np.flatnonzero(np.isin(w.anchors(passage), np.array(places)))
                for c, v in zip(out, (w.runs(at, at + passage).view(np.int64), np.full(len(at), doc), at.astype(np.int32))):
                    c.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["h", "doc", "at"])

    return rows.mapInArrow(run, "h long, doc long, at int")


def _merge(spans: DataFrame) -> DataFrame:
    """Maximal spans of each document's (lo, hi); a document's spans are as many as its words at most."""
    grouped = spans.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("all"))

    def run(batches):
        for b in batches:
            docs, starts, sizes = [], [], []
            for doc, all_ in zip(b.column(0).to_pylist(), b.column(1)):
                v = all_.values.flatten()
                a = np.stack([v[0].to_numpy(), v[1].to_numpy()], axis=1)
                a = a[np.argsort(a[:, 0], kind="stable")]
                end = np.maximum.accumulate(a[:, 1])
                first = np.flatnonzero(np.r_[True, a[1:, 0] > end[:-1]])
                last = np.r_[first[1:], len(a)] - 1
                docs += [None if doc == _NULL else doc] * len(first)
                starts += a[first, 0].tolist()
                sizes += (end[last] - a[first, 0]).tolist()
            yield pa.RecordBatch.from_pydict({"doc_id": docs, "start_word": starts, "n_words": sizes}, schema=pa.schema([("doc_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64())]))

    return grouped.mapInArrow(run, "doc_id long, start_word long, n_words long")


def repeated_passages(docs: DataFrame, passage: int = PASSAGE, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, start_word, n_words): maximal spans made of passages that another document has too."""
    found = materialize(compare_neighbours(materialize(sparse_suffixes(docs, passage)), passage, chunk))
    words = materialize(suffix_words(docs, found.where(F.col("hi").isNull()), passage))
    compared = materialize(compare_words(words, passage, chunk))
    single = materialize(_passages(docs, compared.where(F.col("hi").isNull()), passage))
    shared = single.groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where(F.col("a") != F.col("b")).select("h")
    again = single.join(materialize(shared), "h").select("doc", F.col("at").alias("lo"), (F.col("at") + passage).alias("hi"))
    whole = found.unionAll(compared).where(F.col("hi").isNotNull()).select("doc", "lo", "hi")
    return _merge(whole.unionAll(again))


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


QUERIES = {"op8_repeated_passages": op8_repeated_passages}
ORACLE_SQL = {
    "op8_repeated_passages": f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT doc_id, k, md5(array_to_string(w[k:k + {PASSAGE - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {PASSAGE} + 2)) AS k FROM d)),
s AS (SELECT h FROM v GROUP BY h HAVING count(DISTINCT doc_id) > 1),
p AS (SELECT DISTINCT doc_id, unnest(range(k, k + {PASSAGE})) AS p FROM v JOIN s ON v.h = s.h),
r AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM p)
SELECT doc_id, min(p) - 1 AS start_word, count(*) AS n_words FROM r GROUP BY doc_id, g"""
}
