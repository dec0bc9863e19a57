"""Interval matching of a stream: late rows and repeated rows within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame

from clinloom.operators.range_join import merge_by_range


def stream_by_range(points: DataFrame, ranges: DataFrame, by, x_start: str, x_end: str | None, y_val: str, event_time: str, lateness: str = "1 hour", unique: list[str] | None = None) -> DataFrame:
    """A stream of points joined with static ranges (no relaxation), inner.

    Points later than the watermark are dropped; with `unique`, a point that comes again within
    it is dropped too, and state older than the watermark is freed.
    """
    s = points.withWatermark(event_time, lateness)
    if unique:
        s = s.dropDuplicatesWithinWatermark(unique)
    return merge_by_range(ranges, s, by, x_start, x_end, y_val, all_y=False, keep_row_id=False, validate=False)
