"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Only documents longer than the capacity are cut. All pieces of one length are alike, so
the problem is its length histogram, of at most `capacity` numbers: a configuration linear
program (which sets of lengths fit a sequence, and how many sequences take each set).
It is solved by multiplicative weights on its dual. A knapsack dynamic program over the
capacity prices, in one pass, the best set around every length, which also bounds the
number of sequences from below; every round's sets cover every length, and lengths in poor sets
gain weight. The first solution is best-fit decreasing's, so none is longer. Rounding takes whole
numbers of each set as far as pieces remain and solves again for what is left.

The plan is small and by length and rank; pieces find their place by their rank among
the pieces of their length, so no piece list ever meets in one place.

Defined cases: null text is empty, so its document is its end id alone; very long texts
are cut into pieces of the capacity, the last one shorter; repeated rows are packed each;
a null doc_id is packed like any other; an empty table gives an empty result; other
columns are not returned.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clinloom.llm.common import in_bounded_batches, materialize, table
from clinloom.llm.tokens import encoder, public_path

CAPACITY = 4096
#: Rounds of the weights, and their step.
ROUNDS, STEP = 8, 1.0
#: By pass of a round, the share of the best worth, or of a sequence, that a set may fall short of.
SLACKS = (0.0, 0.002, 0.01, 0.05, 1.0)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth): nth counts a task's pieces of one length."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        enc = encoder(tokenizer)
        for b in in_bounded_batches(batches, rows=1000):
            rows: list[tuple] = []
            for i, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    chunk = ids[at : at + 4 * capacity]
                    n = len(chunk) // 4
                    rows.append((i, k, at // 4, n, zlib.crc32(chunk), part, int(seen[n])))
                    seen[n] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if c in ("piece", "part") else pa.int64()) for c, x in zip(names, zip(*rows))], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


def price(lengths: np.ndarray, value: np.ndarray, capacity: int) -> np.ndarray:
    """By room the greatest total value of pieces that fit, any number of each: the knapsack program over the capacity."""
    worth = np.full(capacity + 1, -np.inf)
    worth[lengths] = value
    best = np.zeros(capacity + 1)
    for c in range(int(lengths[0]), capacity + 1):
        best[c] = max(best[c - 1], (best[:c][::-1] + worth[1 : c + 1]).max())
    return best


class Tracer:
    """Reads best sets off a priced table, from the pieces that there are."""

    def __init__(self, lengths: np.ndarray, value: np.ndarray, capacity: int):
        self.lengths, self.value, self.capacity = lengths, value, capacity
        self.best = price(lengths, value, capacity)
        self.upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")

    def around(self, i: int, left: np.ndarray, cover: np.ndarray | None = None) -> dict[int, int]:
        """A best set with a piece of length i, as places and numbers. Of equally good pieces the less covered, then the longer is taken."""
        s, room = {i: 1}, self.capacity - int(self.lengths[i])
        while m := int(self.upto[room]):
            short = self.lengths[:m]
            v = self.best[room - short] + self.value[:m]
            have = left[:m] > 0
            for k, c in s.items():
                if k < m:
                    have[k] = left[k] > c
            v = np.where(have, v, -1.0)
            top = v.max()
            if top < 0:
                break
            tie = np.flatnonzero(v >= top - 1e-9)
            k = int(tie[-1] if cover is None else tie[np.argmax(short[tie] - self.capacity * cover[tie])])
            s[k] = s.get(k, 0) + 1
            room -= int(short[k])
        return s


class Program(NamedTuple):
    """Weights of the lengths, the greatest lower bound found, and sets with the fractional numbers of sequences that take them; they cover all pieces of every length."""

    weight: np.ndarray
    bound: float
    columns: dict[tuple, float]


def best_fit(lengths: np.ndarray, n: np.ndarray, capacity: int) -> dict[tuple, float]:
    """The sets of a best-fit decreasing packing: the program's first columns."""
    rooms: dict[int, dict[tuple, int]] = {}  # by room the sets with so much left and their numbers
    open_ = [False] * (capacity + 1)
    for i in range(len(lengths) - 1, -1, -1):
        x, todo = int(lengths[i]), int(n[i])
        while todo:
            room = next((r for r in range(x, capacity) if open_[r]), None)
            if room is None:
                s, have, room = (), todo, capacity
            else:
                s, have = rooms[room].popitem()
                open_[room] = bool(rooms[room])
            k = min(room // x, todo) if have == 1 or room == capacity else 1
            m = min(have, max(1, todo // k))
            if m < have and s:
                rooms[room][s] = have - m
                open_[room] = True
            new, left = (*s, *[i] * k), room - k * x
            rooms.setdefault(left, {})
            rooms[left][new] = rooms[left].get(new, 0) + m
            open_[left] = True
            todo -= k * m
    out: dict[tuple, float] = {}
    for sets in rooms.values():
        for s, m in sets.items():
            key = tuple((k, s.count(k)) for k in sorted(set(s)))
            out[key] = out.get(key, 0.0) + m
    return out


def cover(lengths: np.ndarray, n: np.ndarray, capacity: int, weight: np.ndarray, whole: bool = False) -> tuple[dict[tuple, float], np.ndarray, float]:
    """Sets that cover n pieces of every length, with numbers of sequences (whole numbers if asked for); the loss of each length; the worth of the best set.

    Each pass prices the lengths that are left and takes best sets around them, the longest first,
    as often as pieces last, if they come within the pass's slack of the best; the last pass
    takes any. A length's loss is the share of the best worth that its sets fall short of.
    """
    left, value = n.astype(float), lengths / capacity * weight
    columns: dict[tuple, float] = {}
    loss, top = np.zeros(len(lengths)), 0.0
    for slack in SLACKS:
        have = np.flatnonzero(left > 1e-9)
        if not len(have):
            break
        size, y, rest = lengths[have], value[have], left[have]
        tracer = Tracer(size, y, capacity)
        top = top or float(tracer.best[capacity])
        for at in range(len(have) - 1, -1, -1):
            while rest[at] > 1e-9:
                s = tracer.around(at, np.ceil(rest - 1e-9))
                worth = sum(float(y[i]) * k for i, k in s.items())
                if worth < (1 - slack) * top and sum(int(size[i]) * k for i, k in s.items()) < (1 - slack) * capacity:
                    break
                z = min(float(rest[i]) / k for i, k in s.items())
                if whole:
                    z = max(1.0, float(np.floor(z + 1e-9)))
                key = tuple(sorted((int(have[i]), k) for i, k in s.items()))
                columns[key] = columns.get(key, 0.0) + z
                for i, k in s.items():
                    rest[i] = max(0.0, rest[i] - z * k)
                    loss[have[i]] += z * k * (1 - worth / top)
        left[have] = rest
    return columns, loss / n, top


def solve(lengths: np.ndarray, n: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[Program]:
    """The configuration program by multiplicative weights: fewest sequences that cover every length's pieces. Its solutions, the first one best-fit decreasing's.

    A length's dual value is its share of the capacity times its weight. Each round prices all sets
    at once; as no set is worth more than the best, the values of all pieces over that worth bound
    the number of sequences from below. The round's sets cover every length, so each round is a
    primal solution; lengths whose sets are worth less than the best gain weight, and so are
    priced into better sets next. It ends where a solution meets the bound; the first round is
    also taken in whole numbers, which often does.
    """
    weight, bound = np.ones(len(lengths)), float(n @ lengths) / capacity
    found = [Program(weight, bound, c) for c in (best_fit(lengths, n, capacity), cover(lengths, n, capacity, weight, whole=True)[0])]
    for _ in range(rounds):
        if min(sum(p.columns.values()) for p in found) <= np.ceil(bound - 1e-9):
            break
        columns, loss, top = cover(lengths, n, capacity, weight)
        bound = max(bound, float(n @ (lengths * weight)) / capacity / top)
        found.append(Program(weight, bound, columns))
        weight = weight * np.exp(STEP * (loss - np.average(loss, weights=n * lengths)))
    return [p._replace(bound=bound) for p in found]


class Plan(NamedTuple):
    sets: list[tuple[dict[int, int], int]]  # sets of lengths with the number of sequences that take each
    bound: float  # no packing takes fewer sequences
    fractional: float = 0.0  # sequences of the program's solution that the plan was rounded from
    from_program: int = 0  # sequences of the plan that are columns of that solution, not of the program solved again for what was left


def rounded(lengths: np.ndarray, n: np.ndarray, capacity: int, program: Program) -> Plan:
    """Whole numbers of the columns, then by greatest remainder one more of each, as far as pieces last; the program is solved again for what is left."""
    left, listed = n.copy(), lengths.tolist()
    out: list[tuple[dict[int, int], int]] = []

    def take(key: tuple, most: int) -> None:
        m = min(most, *(int(left[i]) // k for i, k in key))
        if m > 0:
            out.append(({listed[i]: k for i, k in key}, m))
            for i, k in key:
                left[i] -= k * m

    for key, z in program.columns.items():
        take(key, int(z + 1e-9))
    for key, z in sorted(program.columns.items(), key=lambda x: (-(x[1] % 1), x[0])):
        if 1e-9 < z % 1 < 1 - 1e-9:
            take(key, 1)
    taken, have = sum(m for _, m in out), np.flatnonzero(left)
    if len(have):
        for key, z in cover(lengths[have], left[have], capacity, program.weight[have], whole=True)[0].items():
            out.append(({listed[have[i]]: k for i, k in key}, int(z)))
    return Plan(out, program.bound, sum(program.columns.values()), taken)


def plan_with_bound(hist: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The program solved, its solutions rounded; the shortest plan stays, of equally short ones a later, priced one."""
    lengths = np.array(sorted(hist), dtype=np.int64)
    if not len(lengths):
        return Plan([], 0.0)
    n = np.array([hist[x] for x in lengths.tolist()], dtype=np.int64)
    return min((rounded(lengths, n, capacity, p) for p in reversed(solve(lengths, n, capacity))), key=lambda p: sum(m for _, m in p.sets))


def plan(hist: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Sets of lengths with the number of sequences that take each; together they take every piece once."""
    return plan_with_bound(hist, capacity).sets


def places(planned: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """The plan by (length, rank): from each first rank on, which sequences and offsets follow."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for s, m in planned:
        offset = 0
        for x, k in sorted(s.items(), reverse=True):
            rows.append((x, used.get(x, 0), m, base, offset))
            used[x] = used.get(x, 0) + k * m
            offset += k * x
        base += m
    a = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return {"key": (a[:, 0] << 48) | a[:, 1], "first": a[:, 1], "m": a[:, 2], "base": a[:, 3], "offset": a[:, 4]}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces(); cut is read several times, so give a materialised one."""
    spark = cut.sparkSession
    counts = materialize(cut.groupBy("part", "length").agg(F.count("*").alias("n")))
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    # each set uses up a length's pieces, or is one of its last few: the capacity bounds them
    shared = spark.sparkContext.broadcast(places(plan(hist, capacity)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranked = cut.join(counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before")), ["part", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches):
        p = shared.value
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(p["key"], (length << 48) | rank, side="right") - 1
            k = rank - p["first"][at]
            cols = [*b.columns[:5], pa.array(p["base"][at] + k % p["m"][at]), pa.array(p["offset"][at] + k // p["m"][at] * length)]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    tokenizer = tokenizer or public_path("word_bpe_49k.json")
    return pack(materialize(pieces(docs, tokenizer, end_id, capacity)), capacity)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their places. Null and empty texts are their end id alone; repeated rows and null ids are packed each; an empty table gives no rows."""
    return pack_documents(docs)


QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
