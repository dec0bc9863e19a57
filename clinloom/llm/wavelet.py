"""Token ids of documents in wavelet-matrix files.

A shard holds the ids of whole documents, in ascending doc_id order, as a wavelet matrix:
one bit plane for each bit of the largest id, highest first; behind each plane the ids
stand stably parted by that bit. With ranks of every 512 bits kept beside the planes, one
compressed file answers access (the id at a place), rank and count (how often an id
occurs), select (where its kth occurrence is) and full decoding.

Files are rows of a Parquet table (part, seq, n_tokens, start_in_part, file), so any store
that Spark writes to will do; `file` is self-contained and may also be kept by itself.

Defined cases: null text is empty, so a document is its end id alone; very long texts are
encoded whole and may fill a shard; repeated rows are written each, ties of doc_id in the
order of a hash of the text; a null doc_id comes first; an empty table gives no file and
an empty result; other columns are not written.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clinloom.llm.common import in_bounded_batches, shared_dir, table
from clinloom.llm.tokens import encoder, public_path

MAGIC = b"CLWM0001"
#: A shard closes after the document with which it reaches as many ids.
SHARD_TOKENS = 1 << 18
STRIDE = 512


class WaveletMatrix:
    """planes: packed bits, zeros: by plane how many ids have a 0 there."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], docs: np.ndarray, lengths: np.ndarray, null: np.ndarray):
        self.n, self.planes, self.zeros, self.docs, self.lengths, self.null = n, planes, zeros, docs, lengths, null
        self._ranks: list[np.ndarray] | None = None

    @classmethod
    def build(cls, ids: np.ndarray, docs, lengths) -> WaveletMatrix:
        bits = max(1, int(ids.max(initial=0)).bit_length())
        a = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for level in range(bits - 1, -1, -1):
            b = (a & a.dtype.type(1 << level)) != 0
            planes.append(np.packbits(b, bitorder="little"))
            low = a.take(np.flatnonzero(~b))  # by places: masks of mixed bits take four times as long
            zeros.append(len(low))
            a = np.concatenate([low, a.take(np.flatnonzero(b))])
        null = np.array([d is None for d in docs], dtype=bool)
        return cls(len(ids), planes, zeros, np.array([d or 0 for d in docs], dtype="<i8"), np.array(lengths, dtype="<i8"), null)

    def to_bytes(self) -> bytes:
        head = struct.pack("<QQI", self.n, len(self.docs), len(self.planes)) + np.array(self.zeros, dtype="<u8").tobytes()
        ranks = b"".join(r.astype("<u4").tobytes() for r in self.ranks)
        body = [head, self.docs.tobytes(), self.lengths.tobytes(), np.packbits(self.null).tobytes(), ranks, *[p.tobytes() for p in self.planes]]
        return MAGIC + zstandard.ZstdCompressor(level=1).compress(b"".join(body))

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        raw = zstandard.ZstdDecompressor().decompress(data[len(MAGIC) :])
        n, d, bits = struct.unpack_from("<QQI", raw)
        at = struct.calcsize("<QQI")

        def part(count: int, kind: str) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(raw, dtype=kind, count=count, offset=at)
            at += got.nbytes
            return got

        zeros = part(bits, "<u8").tolist()
        docs, lengths = part(d, "<i8"), part(d, "<i8")
        null = np.unpackbits(part(-(-d // 8), "u1"), count=d).astype(bool)
        blocks = n // STRIDE + 1
        ranks = [part(blocks, "<u4") for _ in range(bits)]
        out = cls(n, [part(-(-n // 8), "u1") for _ in range(bits)], zeros, docs, lengths, null)
        out._ranks = ranks
        return out

    @property
    def ranks(self) -> list[np.ndarray]:
        """By plane, the ones before every STRIDEth bit."""
        if self._ranks is None:
            self._ranks = []
            for p in self.planes:
                ones = np.zeros(self.n // STRIDE + 2, dtype=np.int64)
                count = np.bitwise_count(p).astype(np.int64)
                whole = np.add.reduceat(count, np.arange(0, len(count), STRIDE // 8)) if len(count) else count
                ones[1 : len(whole) + 1] = whole
                self._ranks.append(np.cumsum(ones)[: self.n // STRIDE + 1])
        return self._ranks

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3] >> (i & 7)) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones before place i."""
        b = i // STRIDE
        lo, hi = b * STRIDE // 8, i >> 3
        got = int(self.ranks[level][b]) + int(np.bitwise_count(self.planes[level][lo:hi]).sum())
        return got + (int(self.planes[level][hi]) & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else got

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(len(self.planes)):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            value = value * 2 + bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where, behind all planes, the occurrences of a token among the first i ids stand."""
        lo, hi = 0, i
        if token < 0 or token >> len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            if token >> (len(self.planes) - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of token before place i."""
        lo, hi = self._range(token, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """The place of the kth (from 0) such bit."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._rank1(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def select(self, token: int, k: int) -> int:
        """The place of the kth occurrence, from 0."""
        lo, hi = self._range(token, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - level) & 1
            i = self._select_bit(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids, from the last plane back to the first."""
        a = np.zeros(self.n, dtype=np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            b = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            z, up = self.zeros[level], np.empty_like(a)
            up[np.flatnonzero(~b)] = a[:z]
            up[np.flatnonzero(b)] = a[z:] | a.dtype.type(1 << (len(self.planes) - 1 - level))
            a = up
        return a.astype("<u4")


_FILES = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_tokens", pa.int64()), ("start_in_part", pa.int64()), ("file", pa.binary())])


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write the documents' (doc_id, text) ids as wavelet-matrix files, in ascending order of doc_id."""
    end = np.array([end_id], dtype="<u4").tobytes()
    tie = F.xxhash64("text")
    order = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)

    def run(batches):
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        enc = encoder(tokenizer)
        docs_: list = []
        data: list[bytes] = []

        def close():
            nonlocal seq, start, docs_, data
            ids = np.frombuffer(b"".join(data), dtype="<u4")
            w = WaveletMatrix.build(ids, docs_, [len(x) // 4 for x in data])
            row = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "n_tokens": [len(ids)], "start_in_part": [start], "file": [w.to_bytes()]}, schema=_FILES)
            seq, start, docs_, data = seq + 1, start + len(ids), [], []
            return row

        have = 0
        for b in in_bounded_batches(batches, rows=500):
            for i, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist())):
                docs_.append(i)
                data.append(ids + end)
                have += len(ids) // 4 + 1
                if have >= shard_tokens:
                    yield close()
                    have = 0
        if docs_:
            yield close()

    order.mapInArrow(run, "part int, seq int, n_tokens long, start_in_part long, file binary").write.parquet(path)


def open_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, seq int, n_tokens long, start_in_part long, file binary").parquet(path)


def read_documents(files: DataFrame) -> DataFrame:
    """From the files alone: doc_id, start, n_tokens, ids_crc32 of every document."""
    # one row a task of the writer, so this window is small however large the corpus
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("part", before.alias("base"))
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for b in batches:
            for part, first, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                w = WaveletMatrix.from_bytes(file.as_py())
                data, n = memoryview(w.decode().tobytes()), w.lengths
                ends = np.cumsum(n)
                crc = [zlib.crc32(data[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(w.docs, mask=w.null), pa.array(first + ends - n), pa.array(n), pa.array(crc, pa.int64())], schema=schema)

    rows = files.select("part", "start_in_part", "file").mapInArrow(run, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(totals, "part").select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def token_counts(files: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n): how often each of a few ids occurs, by rank alone."""

    def run(batches):
        for b in batches:
            for file in b.column(0):
                w = WaveletMatrix.from_bytes(file.as_py())
                yield pa.RecordBatch.from_pydict({"token": tokens, "n": [w.count(t) for t in tokens]}, schema=pa.schema([("token", pa.int64()), ("n", pa.int64())]))

    return files.select("file").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def find_token(files: DataFrame, token: int) -> DataFrame:
    """(doc_id, place): every occurrence of an id, by select."""

    def run(batches):
        for b in batches:
            for file in b.column(0):
                w = WaveletMatrix.from_bytes(file.as_py())
                at = np.array(w.occurrences(token), dtype=np.int64)
                ends = np.cumsum(w.lengths)
                d = np.searchsorted(ends, at, side="right")
                yield pa.RecordBatch.from_arrays([pa.array(w.docs[d], mask=w.null[d]), pa.array(at - (ends - w.lengths)[d])], names=["doc_id", "place"])

    return files.select("file").mapInArrow(run, "doc_id long, place long")


def op5_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_shards(table(spark, sf_dir, "documents"), path, public_path("byte_bpe_50k.json"), end_id=2)
    return read_documents(open_shards(spark, path))


QUERIES = {"op5_wavelet_tokens": op5_wavelet_tokens}
ORACLE_SQL: dict[str, str] = {}
