"""Small helpers on names and lists, on the driver, and their forms for columns."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ten colours of figures.
EMP_COLORS = ("#66C2A5", "#FC8D62", "#8DA0CB", "#E78AC3", "#A6D854", "#FFD92F", "#E5C494", "#B3B3B3", "#ad4c5e", "#474747")


def add_lists(a: dict, b: dict) -> dict:
    """Sums by key over the keys of both."""
    return {k: a.get(k, 0) + b.get(k, 0) for k in [*a, *[k for k in b if k not in a]]}


def add_maps(a: str, b: str) -> Column:
    """add_lists() of two map columns; a null map is empty."""
    none = F.create_map().cast("map<string,bigint>")
    return F.map_zip_with(F.coalesce(a, none), F.coalesce(b, none), lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def common_prefix_of(name: str) -> Column:
    """common_prefix() of a group's values: that of its least and its greatest, so nothing is gathered."""
    lo, hi = F.min(name), F.max(name)
    upto = F.least(F.length(lo), F.length(hi))
    same = F.filter(F.sequence(F.lit(0), upto), lambda i: F.substring(lo, F.lit(1), i) == F.substring(hi, F.lit(1), i))
    return F.substring(lo, F.lit(1), F.array_max(same))


def common_prefix(names: list[str]) -> str:
    return os.path.commonprefix(names)


def merge_ordered_vectors(vectors: list[list]) -> list | None:
    """All elements in an order that most of the lists agree with, pair by pair.

    Elements start in the order first seen; each place then takes over any later element
    that more lists put before than after the one it holds.
    """
    if not vectors:
        return None
    first = [{v: i for i, v in reversed(list(enumerate(vec)))} for vec in vectors]
    out = list(dict.fromkeys(v for vec in vectors for v in vec))

    def votes(a, b) -> int:
        """Lists with a before b, less those with b before a."""
        return sum((f[a] < f[b]) - (f[a] > f[b]) for f in first if a in f and b in f)

    for i in range(len(out)):
        for j in range(i + 1, len(out)):
            if votes(out[i], out[j]) < 0:
                out[i], out[j] = out[j], out[i]
    return out


def vec2code(values: list) -> str:
    return "c(" + ", ".join("NA" if v is None else f"'{v}'" for v in values) + ")"


def name2code(df) -> str:
    """Of a DataFrame's column names, or a mapping's keys."""
    return vec2code(list(getattr(df, "columns", df)))
