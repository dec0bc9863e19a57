"""Text cleaning and recoding as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width forms and their half-width ones, by code point, and the ideographic space.
FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
HALF = "".join(chr(c) for c in range(0x21, 0x7F)) + " "


def half_width(x: Column) -> Column:
    return F.translate(x, FULL, HALF)


def value_initial_cleaning(x: Column, remove_inequal: bool = False, strict: bool = False) -> Column:
    """Text of a value: half-width, runs of dots as one, no spaces, empty as null.

    remove_inequal drops comparison signs; with strict also the letters of their escaped
    forms, wherever they stand.
    """
    x = F.regexp_replace(half_width(x), r"\.+", ".")
    x = F.regexp_replace(x, r"\s+", "")
    if remove_inequal:
        x = F.regexp_replace(x, r"[<>≤≥&ltg;]" if strict else r"[<>≤≥]|&lt;|&gt;", "")
    return F.nullif(x, F.lit(""))


def char_initial_cleaning(x: Column) -> Column:
    """Half-width, white space squeezed and trimmed, empty as null."""
    return F.nullif(F.trim(F.regexp_replace(half_width(x), r"\s+", " ")), F.lit(""))


def str_match_replace(x: Column, to_match: list[str], to_replace: list[str]) -> Column:
    """Literal replacements one after another, the longest pattern first."""
    if len(to_match) != len(to_replace):
        raise ValueError("to_match and to_replace differ in length")
    order = sorted(range(len(to_match)), key=lambda i: -len(to_match[i]))
    return reduce(lambda c, i: F.replace(c, F.lit(to_match[i]), F.lit(to_replace[i])), order, x)


def replace_elements(x: Column, from_: list, to: list) -> Column:
    """Exact recoding, null included; pairs apply in turn, so a value may change more than once."""
    if len(from_) != len(to):
        raise ValueError("from_ and to differ in length")
    return reduce(lambda c, p: F.when(c.eqNullSafe(F.lit(p[0])), F.lit(p[1])).otherwise(c), zip(from_, to), x)


def keep_by_keyword(x: Column, keyword: str, from_: str = "start", to: str = "first", include_keyword: bool = True) -> Column:
    """What lies between two places that matches of a pattern give; empty without a match.

    from_: start, first or last match; to: first or last match, or end. Matches do not overlap.
    """
    if from_ not in ("start", "first", "last") or to not in ("first", "last", "end"):
        raise ValueError("from_ is start, first or last; to is first, last or end")
    x = x.cast("string")
    if from_ == "start" and to == "end":
        return x
    if from_ == "last" and to == "first":
        raise ValueError("the last match does not come before the first")
    parts = F.split(x, keyword)
    hits = F.regexp_extract_all(x, F.lit(f"({keyword})"), F.lit(1))
    n = F.size(hits)
    # a text is parts[0] hits[0] parts[1] hits[1] ... parts[n]
    woven = F.concat(F.flatten(F.zip_with(F.slice(parts, 1, n), hits, lambda p, h: F.array(p, h))), F.slice(parts, n + 1, F.lit(1)))
    at = {"start": F.lit(1), "first": F.lit(2), "last": 2 * n, "end": 2 * n + 1}
    lo, hi = at[from_], at[to]
    if not include_keyword:
        lo = lo + 1 if from_ != "start" else lo
        hi = hi - 1 if to != "end" else hi
    got = F.array_join(F.slice(woven, lo, F.greatest(hi - lo + 1, F.lit(0))), "")
    return F.when(x.isNull(), None).when(n == 0, F.lit("")).otherwise(got)
