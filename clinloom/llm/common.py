"""What the operators of this package share: reading, materialising, words and hashes."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)
_BASE = 0x9FB21C651E98DF25 | 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that all executors and the driver share.

    The cluster names that folder in spark.checkpoint.dir. Only where it is unset and
    Spark runs within this machine, as in local tests, a temporary folder is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.clinloom.local.checkpoint.dir", None)
        if not root:
            master = spark.sparkContext.master
            if not re.fullmatch(r"local(\[.*\])?", master):
                raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
            root = "file://" + tempfile.mkdtemp(prefix="clinloom-")
            spark.conf.set("spark.clinloom.local.checkpoint.dir", root)
    return f"{root.rstrip('/')}/clinloom-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_KEPT: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What a worker keeps for one operator from task to task. Spark reuses workers, so what it kept for the others goes."""
    mine = _KEPT.setdefault(owner, {})
    if others := [v for v in _KEPT.values() if v and v is not mine]:
        for v in others:
            v.clear()
        pa.default_memory_pool().release_unused()
    return mine


def quoted(name: str) -> str:
    """A column's name as Spark reads it, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _S)
    x = x * _M1
    x = x ^ (x >> _S)
    x = x * _M2
    return x ^ (x >> _S)


def _byte_codes(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


_CODES = _byte_codes(20240229)
_INV = pow(_BASE, -1, 2**64)
_POW_CACHE: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, modulo 2^64, of the base and of its inverse."""
    have = _POW_CACHE.get("b")
    if have is None or len(have) < n:
        n = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for key, base in (("b", _BASE), ("i", _INV)):
                p = np.full(n, base, dtype=np.uint64)
                p[0] = 1
                _POW_CACHE[key] = np.multiply.accumulate(p)
    return _POW_CACHE["b"], _POW_CACHE["i"]


BLOCK = 1 << 16


def word_spans(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes for which is_word holds."""
    flag = np.zeros(len(data) + 2, dtype=np.int8)
    flag[1:-1] = is_word[data]
    step = np.diff(flag)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word data[start:end], alike wherever the word stands.

    Polynomial prefix sums give every word's hash without a loop over words.
    Powers restart with each stretch of BLOCK bytes, so tables stay small however
    long the text is; longer words are hashed one at a time.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    if not len(starts):
        return out
    with np.errstate(over="ignore"):
        lo = 0
        while lo < len(starts):
            first = int(starts[lo])
            hi = int(np.searchsorted(ends, first + BLOCK, side="right"))
            hi = max(hi, lo + 1)
            last = int(ends[hi - 1])
            n = last - first
            up, down = _powers(n + 1)
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_CODES[data[first:last]] * up[:n], out=total[1:])
            s, e = starts[lo:hi] - first, ends[lo:hi] - first
            h = (total[e] - total[s]) * down[s]
            out[lo:hi] = mix64(h + (e - s).astype(np.uint64) * _GOLD)
            lo = hi
    return out


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER_BYTES = lower_table()
#: Bytes of words that end at white space: all but U+0020 and U+0009 to U+000D.
SPACE_WORD = np.ones(256, dtype=bool)
SPACE_WORD[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of words after lower-casing that hold digits, a to z and all beyond ASCII.
ALNUM_WORD = np.zeros(256, dtype=bool)
ALNUM_WORD[48:58] = ALNUM_WORD[97:123] = ALNUM_WORD[128:] = True


def text_words(text: str | None, is_word: np.ndarray) -> np.ndarray:
    """Hashes of the words of a text, its A-Z lower-cased."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    data = LOWER_BYTES[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    s, e = word_spans(data, is_word)
    return hash_words(data, s, e)


def gram_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of n words, in order."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint64)
    out = np.full(len(words) - n + 1, 0x51ED270B + seed, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out *= _M2
            out += words[k : len(words) - n + 1 + k]
            out ^= out >> np.uint64(29)
        return mix64(out)


def in_bounded_batches(batches, rows: int = 2000, chars: int = 16 << 20):
    """Arrow batches cut so that no piece has more than that many rows, nor, unless it is one row, far more text."""
    for b in batches:
        step = max(1, min(rows, b.num_rows, int(b.num_rows * chars / max(1, b.nbytes))))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)
