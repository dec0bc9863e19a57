"""Periodic runs of words within a document, found by matching aligned blocks.

A run is a stretch of consecutive words with smallest period q, of max(6, 4q) words or more, that
neither neighbour extends. At each scale B = 1, 2, 4, ... the blocks that begin at multiples
of B are keys, as sequences of word numbers, of one automaton, which is searched across the text.
A run whose period lies in [B, 2B) holds an aligned block within its first 2B - 1 words and the same
block q words on, so an occurrence at a distance in [B, 2B) after an aligned block is a seed:
it is extended word by word to both sides as far as words q apart are identical.

Two exact tests keep the work near n log n, whatever the text:

- every word of such a run but its last q has its like within less than 2B words, so only blocks within
  stretches of 3B such words are keys;
- a seed within a known run of smaller period can only give that run again, so it is left out.

Words are numbered within a document by their bytes; nothing is compared by hash. A document
is one row of one task, which needs memory in proportion to its length.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinloom.llm.common import in_bounded_batches, table

LEAST_WORDS, LEAST_PERIODS = 6, 4
SPACE = r"[\x20\x09-\x0D]+"


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers, from 0 in order of their first place."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def _next_like(ids: np.ndarray) -> np.ndarray:
    """Words from each place to the next place of the same word; the text's length where there is none."""
    order = np.argsort(ids, kind="stable")
    out = np.full(len(ids), len(ids), dtype=np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    out[order[:-1][same]] = np.diff(order)[same]
    return out


def _stretches(flag: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal stretches of true places that are long enough."""
    step = np.diff(np.r_[0, flag.astype(np.int8), 0])
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    keep = end - begin >= least
    return begin[keep], end[keep]


def _alike(ids: np.ndarray, q: int, at: int, back: bool) -> int:
    """How many words from `at` on, or back from the one before it, equal the word q places on."""
    n, step = 0, 16
    while True:
        lo, hi = (max(0, at - n - step), at - n) if back else (at + n, min(len(ids) - q, at + n + step))
        if lo >= hi:
            return n
        odd = np.flatnonzero(ids[lo:hi] != ids[lo + q : hi + q])
        if len(odd):
            return n + (hi - lo - 1 - int(odd[-1]) if back else int(odd[0]))
        n, step = n + hi - lo, 2 * step


def _seeds(ids: np.ndarray, begin: int, end: int, size: int, covered: np.ndarray):
    """(place of an aligned block, distance to an occurrence) for distances from size up to twice the size, less one.

    Blocks lie in [begin, end). covered: for each place, where the known run that holds it and ends last ends.
    """
    starts = np.arange(-(-begin // size) * size, end - size + 1, size)
    starts = starts[covered[starts] < starts + 3 * size - 1]  # else all occurrences lie within a known run
    if not len(starts):
        return
    blocks, at = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE), {}
    for s in starts.tolist():
        key = tuple(ids[s : s + size].tolist())
        at[s] = blocks.get(key, s)  # the first place of the same block names it
        if at[s] == s:
            blocks.add_word(key, s)
    blocks.make_automaton()
    for few in np.split(starts, np.flatnonzero(np.diff(starts) > size) + 1):
        lo = int(few[0]) + size
        for last, name in blocks.iter(tuple(ids[lo : int(few[-1]) + 3 * size - 1].tolist())):
            here = lo + last - size + 1
            s = (here - size) // size * size
            if at.get(s) == name and here + size > covered[s]:
                yield s, here - s


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and then period."""
    n = len(ids)
    if n < LEAST_WORDS:
        return []
    like, found, size = _next_like(ids), {}, 1
    while LEAST_PERIODS * size <= n:
        begins, ends = _stretches(like < 2 * size, max((LEAST_PERIODS - 1) * size, LEAST_WORDS - 1))
        if len(begins):
            covered = np.zeros(n, dtype=np.int64)
            for start, end in found:
                covered[start] = max(covered[start], end)
            np.maximum.accumulate(covered, out=covered)
            new, tried = {}, {}
            for b, e in zip(begins.tolist(), ends.tolist()):
                for s, q in _seeds(ids, b, e, size, covered):
                    lo, hi = tried.get(q, (0, 0))
                    if lo <= s and s + size <= hi:
                        continue
                    lo, hi = s - _alike(ids, q, s, True), s + size + _alike(ids, q, s + size, False)
                    tried[q] = lo, hi
                    # a smaller period of a stretch this long divides q, so it was found at an earlier scale
                    if hi + q - lo >= max(LEAST_WORDS, LEAST_PERIODS * q) and (lo, hi + q) not in found:
                        new[lo, hi + q] = q
            found |= new
        size *= 2
    return sorted((s, e - s, q) for (s, e), q in found.items())


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: all but those in a run after its first period."""
    step = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:n]) == 0


_RUN = "array<struct<start: long, length: long, period: long>>"
_RUN_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Of documents (doc_id, text): doc_id, n_words, runs (start, length and period in words, by start and then period) and collapsed, the text with each run cut to its first period, words joined by one space.

    Null and blank texts have no words, no runs and an empty collapsed text. Every row gives one row, also
    where doc_id is null or repeated; other columns, whatever their names, are not read.
    """

    def run(batches):
        for b in in_bounded_batches(batches):
            sizes, runs, short = [], [], []
            for text in b.column(1).to_pylist():
                words = (text or "").encode("utf-8", "surrogatepass").split()  # bytes are split at U+0020 and U+0009 to U+000D only
                got = find_runs(word_numbers(words))
                sizes.append(len(words))
                if got:
                    words = [words[i] for i in np.flatnonzero(kept_words(len(words), got)).tolist()]
                runs.append([{"start": s, "length": l, "period": q} for s, l, q in got])
                short.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(runs, _RUN_ARROW), pa.array(short, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, runs {_RUN}, collapsed string")


def longest_run(runs):
    """Of a column of runs, the one of greatest exponent: length over period, compared exactly; ties go to the earliest."""
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, none, lambda best, r: F.when(more(best, r), r).otherwise(best))


def repeated_tails(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text), a tenth of them with the words from one place on made periodic.

    With h the crc32 of the decimal doc_id and g = h div 10, where 10 divides h and there are n > 0 words,
    each word i from a = g % n on becomes the word a + (i - a) % p, with p = 1 + (n - a) div (3 + g % 8).
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    hit = F.coalesce(h % 10 == 0, F.lit(False))
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    d = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(hit, words).alias("words"))
    n = F.size("words")
    d = d.withColumn("n", n.cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    d = d.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = (F.col("n") - F.col("a")).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    made = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), rest)), " ")
    return d.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(repeated_tails(table(spark, sf_dir, "documents"))).withColumn("best", longest_run(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
ORACLE_SQL: dict[str, str] = {}
