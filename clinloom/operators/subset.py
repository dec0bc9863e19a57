"""The largest part of a table that keeps missing values under given rates, by greedy removal."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clinloom.operators.quality import _missing


class _State:
    """Rows with the same missing columns are alike: patterns with counts stand for them."""

    def __init__(self, pattern: np.ndarray, count: np.ndarray, first: np.ndarray):
        self.m, self.total, self.first = pattern.astype(float), count.copy(), first
        self.left = count.astype(np.int64).copy()
        self.cols = np.ones(pattern.shape[1], dtype=bool)

    def row_rates(self) -> np.ndarray:
        k = self.cols.sum()
        return self.m[:, self.cols].sum(axis=1) / k if k else np.zeros(len(self.m))

    def col_rates(self) -> np.ndarray:
        n = self.left.sum()
        return (self.m * self.left[:, None]).sum(axis=0) / n if n else np.zeros(self.m.shape[1])


def _score(s: _State, row_max: float, col_max: float, priority: float, adaptive: bool) -> tuple[np.ndarray, np.ndarray]:
    """Scores of removing a row of each pattern and each column; -inf where it is no candidate."""
    r, c = s.row_rates() - row_max, s.col_rates() - col_max
    rows = np.where(s.left > 0, r, -np.inf)
    cols = np.where(s.cols, c, -np.inf)
    if not adaptive:
        return np.where(rows > 1e-12, rows / priority, -np.inf), np.where(cols > 1e-12, cols, -np.inf)
    n, k = s.left.sum(), s.cols.sum()
    over_c, over_r = np.clip(c, 0, None) * s.cols, np.clip(r, 0, None) * (s.left > 0)
    rate_c = s.col_rates()
    gain_r = np.array([(over_c - np.clip(((rate_c * n - s.m[i]) / max(n - 1, 1)) - col_max, 0, None) * s.cols).sum() / max(k, 1) for i in range(len(s.m))])
    rate_r = s.row_rates()
    gain_c = np.array([((over_r - np.clip(((rate_r * k - s.m[:, j]) / max(k - 1, 1)) - row_max, 0, None) * (s.left > 0)) * s.left).sum() / max(n, 1) for j in range(s.m.shape[1])])
    rs, cs = np.where(s.left > 0, (gain_r + np.clip(r, 0, None)) / priority, -np.inf), np.where(s.cols, gain_c + np.clip(c, 0, None), -np.inf)
    return np.where(rs > 1e-12, rs, -np.inf), np.where(cs > 1e-12, cs, -np.inf)


def _first_true(holds: Callable[[np.ndarray], np.ndarray], top: int, shape: int) -> np.ndarray:
    """The least k in 1..top-1 from which on each of the monotone conditions holds, else top."""
    lo, hi = np.ones(shape, dtype=np.int64), np.full(shape, max(top, 1), dtype=np.int64)
    while (lo < hi).any():
        mid = (lo + hi) // 2
        ok = holds(mid) | (lo >= hi)
        hi, lo = np.where(ok, mid, hi), np.where(ok, lo, np.minimum(mid + 1, hi))
    return hi


def _remove_runs(s: _State, row_max: float, col_max: float, priority: float) -> None:
    """The plain removal, one best row or column after the other, with a pattern's rows in runs.

    Row scores change only with the columns, so the best pattern stays best until it is used up or
    the rate of a column that it does not lack has risen beyond its score.
    """
    n, missing = int(s.left.sum()), (s.m * s.left[:, None]).sum(axis=0)

    def col_scores(k: int, i: int) -> np.ndarray:
        c = ((missing - k * s.m[i]) / (n - k) if n > k else np.zeros(len(missing))) - col_max
        return np.where(s.cols & (c > 1e-12), c, -np.inf)

    while n and s.cols.any():
        r = s.row_rates() - row_max
        score = np.where((s.left > 0) & (r > 1e-12), r / priority, -np.inf)
        order = np.lexsort((s.first, -score))
        column = None
        for i in order[np.isfinite(score[order])]:
            c = col_scores(0, i)
            if c.max() > score[i]:
                column = int(c.argmax())
                break
            top = int(s.left[i])
            k = int(_first_true(lambda k: np.array([col_scores(int(v), i).max() > score[i] for v in k]), top, 1)[0])
            s.left[i] -= k
            n, missing = n - k, missing - k * s.m[i]
            if k < top:
                column = int(col_scores(0, i).argmax())
                break
            if not n:
                return
        if column is None:
            c = col_scores(0, 0)
            if not np.isfinite(c.max()):
                return
            column = int(c.argmax())
        s.cols[column] = False


def _restore(s: _State, row_max: float, col_max: float, priority: float) -> None:
    """What was removed too early comes back, the closest to its bound first, a pattern's rows in runs.

    A run ends before the first row after which another option would come first or nothing would fit.
    """
    eps = 1e-12
    while True:
        n, missing = int(s.left.sum()), (s.m * s.left[:, None]).sum(axis=0)
        rates = s.row_rates()
        fits_rows = bool((rates[s.left > 0] <= row_max + eps).all())
        back = np.flatnonzero((s.left < s.total) & (rates <= row_max + eps))
        score = -(rates - row_max) / priority
        gone = np.flatnonzero(~s.cols)
        col_rate = missing / n if n else np.ones(len(missing))
        options = [(score[i], 0, s.first[i], i) for i in back] + [(-(col_rate[j] - col_max), 1, j, j) for j in gone if col_rate[j] <= col_max + eps]
        on = s.cols

        def fits_row(i: int | np.ndarray) -> np.ndarray:
            return ((missing + s.m[i])[..., on] / (n + 1) <= col_max + eps).all(axis=-1)

        def rows_with(j: int) -> bool:
            return bool((((s.m[:, on].sum(axis=1) + s.m[:, j]) / (on.sum() + 1))[s.left > 0] <= row_max + eps).all())

        can = dict(zip(back.tolist(), np.atleast_1d(fits_row(back)).tolist())) if len(back) else {}
        options.sort()
        for at, (_, kind, _, i) in enumerate(options):
            if kind == 0 and fits_rows and can[i]:
                break
            if kind == 1 and rows_with(i) and (not n or bool((col_rate[on] <= col_max + eps).all())):
                break
        else:
            return
        if kind == 1:
            s.cols[i] = True
            continue
        m, top = s.m[i], int(s.total[i] - s.left[i])
        run = top
        if top > 1 and on.any():
            # i itself no longer fits
            run = min(run, int(_first_true(lambda k: np.array([((missing + (v + 1) * m)[on] / (n + v + 1) > col_max + eps).any() for v in k]), top, 1)[0]))
            # a pattern that comes before i begins to fit: falling rates must have come down, rising ones not yet be above
            h = np.array([o[3] for o in options[:at] if o[1] == 0], dtype=int)
            if len(h) and run > 1:
                low, up = on & (m == 0), on & (m == 1)
                begin = _first_true(lambda k: ((missing + s.m[h])[:, low] / (n + k + 1)[:, None] <= col_max + eps).all(axis=1), run, len(h))
                end = _first_true(lambda k: ((missing + s.m[h] + k[:, None])[:, up] / (n + k + 1)[:, None] > col_max + eps).any(axis=1), run, len(h))
                run = min(run, int(np.where(begin < end, begin, run).min()))
        if run > 1 and len(gone):
            s.left[i] += 1
            j = np.array([j for j in gone if rows_with(j)], dtype=int)
            s.left[i] -= 1
            if len(j):
                rate = lambda k: (missing[j] + k * m[j]) / (n + k)
                valid, ahead = lambda k: rate(k) <= col_max + eps, lambda k: -(rate(k) - col_max) < score[i]
                rising = m[j] == 1
                begin = _first_true(lambda k: np.where(rising, ahead(k), valid(k)), run, len(j))
                end = _first_true(lambda k: np.where(rising, ~valid(k), ~ahead(k)), run, len(j))
                run = min(run, int(np.where(begin < end, begin, run).min()))
        s.left[i] += run


def greedy(pattern: np.ndarray, count: np.ndarray, first: np.ndarray, row_max: float, col_max: float, priority: float = 1.0, adaptive: bool = False, speedup: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """How many rows of each pattern stay, and which columns."""
    s = _State(pattern, count, first)
    if not adaptive and not speedup:
        _remove_runs(s, row_max, col_max, priority)
    while s.left.sum() and s.cols.any():
        rs, cs = _score(s, row_max, col_max, priority, adaptive)
        n = int((s.left * np.isfinite(rs)).sum() + np.isfinite(cs).sum())
        if not n:
            break
        todo = max(1, round(speedup * n))
        order = sorted([(-v, 0, first[i], i) for i, v in enumerate(rs) if np.isfinite(v)] + [(-v, 1, j, j) for j, v in enumerate(cs) if np.isfinite(v)])
        for _, kind, _, i in order:
            if todo <= 0:
                break
            if kind == 0:
                gone = min(todo, int(s.left[i])) if speedup else 1
                s.left[i] -= gone
                todo -= gone
            else:
                s.cols[i] = False
                todo -= 1
    _restore(s, row_max, col_max, priority)
    return s.left, s.cols


def get_valid_subset(df: DataFrame, order_by: str, columns: list[str] | None = None, row_na_ratio: float = 0.5, col_na_ratio: float = 0.2, row_priority: float = 1.0, adaptive_scoring: bool = False, speedup_ratio: float = 0.0, max_patterns: int = 1 << 20) -> DataFrame:
    """Rows and columns of which the missing rates do not exceed the ratios.

    The greedy loop runs on the patterns of missing columns, at most max_patterns of them (more
    raise), which one aggregate counts; the kept number of each pattern's rows then joins back,
    rows in order_by order. Columns not among `columns` pass through.
    """
    if not (0 <= row_na_ratio <= 1 and 0 <= col_na_ratio <= 1 and row_priority > 0 and 0 <= speedup_ratio <= 1):
        raise ValueError("ratios lie between 0 and 1, row_priority above 0")
    columns = columns or [c for c in df.columns if c != order_by]
    bits = F.concat(*[F.when(_missing(df, c), F.lit("1")).otherwise(F.lit("0")) for c in columns])
    marked = df.withColumn("_p", bits)
    rows = marked.groupBy("_p").agg(F.count("*").alias("n"), F.min(order_by).alias("f")).orderBy("f").limit(max_patterns + 1).collect()
    if len(rows) > max_patterns:
        raise ValueError("too many patterns of missing values")
    if not rows:
        return df
    pattern = np.array([[ch == "1" for ch in r["_p"]] for r in rows])
    left, cols = greedy(pattern, np.array([r["n"] for r in rows]), np.arange(len(rows)), row_na_ratio, col_na_ratio, row_priority, adaptive_scoring, speedup_ratio)
    keep = df.sparkSession.createDataFrame([(r["_p"], int(k), bool(k == r["n"])) for r, k in zip(rows, left) if k], "_q string, _k long, _all boolean")
    met = marked.join(keep, F.col("_p") == F.col("_q"))
    whole = met.where("_all")
    # of a pattern that is kept in part its last rows stay
    part = met.where("NOT _all").withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(F.desc(order_by)))).where("_r <= _k").drop("_r")
    names = [c for c in df.columns if c not in columns or cols[columns.index(c)]]
    return whole.unionByName(part).select(*names)
