"""Cohort screening over several tables: entry, anchor and follow-up rules.

A rule is a tree of terms: any_(table, predicate), all_(table, predicate),
agg_(table, "mean", "value", na_rm) compared with a number, or sql_(table, expression) for any other
aggregate; `&` intersects the keys that satisfy terms, `|` unites them. Keys are
patients, or patients with a visit or a date. A term sees only keys of its own table.
"""

from __future__ import annotations

import operator
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinloom.functions.numbers import as_numeric

PATIENT, VISIT, DATE = "patient_id", "visit_id", "date"
LEVELS = {PATIENT: (PATIENT,), VISIT: (PATIENT, VISIT), DATE: (PATIENT, DATE)}


class Rule:
    def __and__(self, other: Rule) -> Rule:
        return Both(self, other)

    def __or__(self, other: Rule) -> Rule:
        return Either(self, other)


@dataclass(frozen=True)
class Both(Rule):
    a: Rule
    b: Rule


@dataclass(frozen=True)
class Either(Rule):
    a: Rule
    b: Rule


@dataclass(frozen=True)
class Term(Rule):
    table: str
    flag: Callable[[], Column]
    one_row: bool = False


def _col(pred) -> Column:
    return F.expr(pred) if isinstance(pred, str) else pred


def any_(table: str, pred) -> Term:
    """Some row satisfies the predicate; null does not."""
    return Term(table, lambda: F.bool_or(F.coalesce(_col(pred), F.lit(False))))


def all_(table: str, pred) -> Term:
    """Every row satisfies the predicate; null does not."""
    return Term(table, lambda: F.bool_and(F.coalesce(_col(pred), F.lit(False))))


def sql_(table: str, expression) -> Term:
    """Any aggregate that gives a truth value."""
    return Term(table, lambda: _col(expression))


def row_(table: str, pred) -> Term:
    """A predicate on rows, legal only where each key has one row."""
    return Term(table, lambda: F.when(F.count("*") == 1, F.first(_col(pred))).otherwise(F.raise_error(F.lit("a row-wise term needs one row for each key"))), one_row=True)


class Agg:
    def __init__(self, table: str, fun: str, column: str, na_rm: bool):
        if fun not in ("mean", "sum", "min", "max"):
            raise ValueError(f"unknown aggregate: {fun}")
        self.table, self.fun, self.column, self.na_rm = table, fun, column, na_rm

    def value(self) -> Column:
        x = F.col(self.column).cast("double")
        if self.fun == "mean":
            v = F.avg(x)
        elif self.fun == "sum":
            v = F.coalesce(F.sum(x), F.lit(0.0))
        else:  # without any value the least is infinite, as is the largest with a minus
            v = F.coalesce(F.min(x), F.lit(float("inf"))) if self.fun == "min" else F.coalesce(F.max(x), F.lit(float("-inf")))
        return v if self.na_rm else F.when(F.count_if(x.isNull()) == 0, v)

    def _term(self, op, k) -> Term:
        return Term(self.table, lambda: op(self.value(), F.lit(float(k))))

    def __gt__(self, k) -> Term:
        return self._term(operator.gt, k)

    def __ge__(self, k) -> Term:
        return self._term(operator.ge, k)

    def __lt__(self, k) -> Term:
        return self._term(operator.lt, k)

    def __le__(self, k) -> Term:
        return self._term(operator.le, k)

    def __eq__(self, k) -> Term:  # type: ignore[override]
        return self._term(operator.eq, k)

    def __ne__(self, k) -> Term:  # type: ignore[override]
        return self._term(operator.ne, k)

    __hash__ = None  # type: ignore[assignment]


def agg_(table: str, fun: str, column: str, na_rm: bool = False) -> Agg:
    return Agg(table, fun, column, na_rm)


@dataclass
class ScreenResult:
    data: dict[str, DataFrame] | DataFrame
    audit: dict[str, DataFrame] = field(default_factory=dict)


class Database:
    """Tables and which of their columns hold patient, visit and date."""

    def __init__(self, tables: dict[str, DataFrame], patient, visit=None, date=None):
        if not tables or not all(tables):
            raise ValueError("tables must be named")
        for name, df in tables.items():
            if len({c.lower() for c in df.columns}) != len(df.columns):
                raise ValueError(f"{name} has columns of one name")
        self.tables = dict(tables)
        self.maps = {PATIENT: self._map(patient, PATIENT), VISIT: self._map(visit, VISIT), DATE: self._map(date, DATE)}
        if missing := set(tables) - set(self.maps[PATIENT]):
            raise ValueError(f"no patient column for {sorted(missing)}")

    def _map(self, spec, what: str) -> dict[str, str]:
        if spec is None:
            return {}
        if isinstance(spec, str):
            got = {n: spec for n, df in self.tables.items() if spec in df.columns}
            if not got:
                raise ValueError(f"no table has the column {spec} for {what}")
            return got
        for n, c in spec.items():
            if n not in self.tables or c not in self.tables[n].columns:
                raise ValueError(f"{what}: no column {c} in table {n}")
        return dict(spec)

    def keys(self, table: str, level: str) -> list[Column] | None:
        """The level's key columns of a table, or None if it lacks one."""
        parts = LEVELS[level]
        if not all(table in self.maps[p] for p in parts):
            return None
        return [F.col(self.maps[p][table]).alias(f"_k_{p}") for p in parts]


def _terms(rule: Rule) -> list[Term]:
    return [rule] if isinstance(rule, Term) else _terms(rule.a) + _terms(rule.b)


def _truth(rule: Rule, flags: dict[int, str]) -> Column:
    if isinstance(rule, Term):
        return F.coalesce(F.col(flags[id(rule)]), F.lit(False))
    a, b = _truth(rule.a, flags), _truth(rule.b, flags)
    return a & b if isinstance(rule, Both) else a | b


def satisfied(db: Database, tables: dict[str, DataFrame], rule: Rule, level: str) -> DataFrame:
    """The keys that satisfy a rule: one aggregate for each table, its flags joined on the keys."""
    names = [f"_k_{p}" for p in LEVELS[level]]
    by: dict[str, list[tuple[str, Term]]] = {}
    flags: dict[int, str] = {}
    for i, t in enumerate(_terms(rule)):
        if t.table not in tables:
            raise ValueError(f"unknown table {t.table}")
        flags[id(t)] = f"_f{i}"
        by.setdefault(t.table, []).append((f"_f{i}", t))
    parts = []
    for table, terms in by.items():
        keys = db.keys(table, level)
        if keys is None:
            raise ValueError(f"{table} lacks a column for the level {level}")
        keyed = tables[table].withColumns({f"_k_{p}": F.col(db.maps[p][table]) for p in LEVELS[level]}).where(F.col(f"_k_{PATIENT}").isNotNull())
        parts.append(keyed.groupBy(*names).agg(*[t.flag().alias(f) for f, t in terms]))

    def join(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select(*[F.col(n).alias(f"{n}_r") for n in names], *[c for c in b.columns if c not in names])
        out = a.join(b, [a[n].eqNullSafe(b[f"{n}_r"]) for n in names], "full_outer")
        return out.select(*[F.coalesce(n, f"{n}_r").alias(n) for n in names], *[c for c in out.columns if c.startswith("_f")])

    return reduce(join, parts).where(_truth(rule, flags)).select(*names)


def _keep(db: Database, name: str, df: DataFrame, selected: DataFrame, level: str) -> DataFrame:
    """Rows of the selected keys; a table without the level's column goes by patient."""
    use = level if db.keys(name, level) is not None else PATIENT
    names = [f"_k_{p}" for p in LEVELS[use]]
    chosen = selected.select(*names).distinct() if use != level else selected
    return df.join(chosen, [df[db.maps[p][name]].eqNullSafe(chosen[f"_k_{p}"]) for p in LEVELS[use]], "left_semi")


def _all_numbers(x: Column) -> Column:
    return F.count(x) == F.count(as_numeric(x.cast("string")))


def _anchor(db: Database, tables: dict[str, DataFrame], rule: Rule, level: str) -> dict[str, DataFrame]:
    """Rows at or after each patient's first key that satisfies the rule.

    Keys that are text order as numbers where all on both sides are numbers, else as text.
    """
    keys = satisfied(db, tables, rule, level)
    key = F.col(f"_k_{level}")
    text = dict(keys.dtypes)[f"_k_{level}"] == "string"
    least = F.when(_all_numbers(key), F.min_by(key, as_numeric(key))).otherwise(F.min(key)) if text else F.min(key)
    first = keys.groupBy(f"_k_{PATIENT}").agg(least.alias("_from"))
    out = {}
    for name, df in tables.items():
        column = db.maps[level].get(name)
        if column is None:
            out[name] = df.join(first, df[db.maps[PATIENT][name]] == first[f"_k_{PATIENT}"], "left_semi")
            continue
        from_ = first
        if text or dict(df.dtypes)[column] == "string":
            # one row: whether either side holds other text than numbers
            told = df.agg(_all_numbers(F.col(f"`{column}`")).alias("_here")).join(first.agg(_all_numbers(F.col("_from")).alias("_there")), F.lit(True))
            from_ = first.join(told.select((F.col("_here") & F.col("_there")).alias("_num")), F.lit(True))
            left, right = df[column].cast("string"), from_["_from"].cast("string")
            later = F.when(from_["_num"], as_numeric(left) >= as_numeric(right)).otherwise(left >= right)
        else:
            later = df[column] >= from_["_from"]
        out[name] = df.join(from_, (df[db.maps[PATIENT][name]] == from_[f"_k_{PATIENT}"]) & later, "left_semi")
    return out


def _followup(db: Database, tables: dict[str, DataFrame], table: str, least: int) -> dict[str, DataFrame]:
    visits = tables[table].select(F.col(db.maps[PATIENT][table]).alias(f"_k_{PATIENT}"), F.col(db.maps[VISIT][table]).alias("_v"))
    enough = visits.where(F.col(f"_k_{PATIENT}").isNotNull()).groupBy(f"_k_{PATIENT}").agg(F.count_distinct("_v").alias("_n")).where(F.col("_n") >= least).select(f"_k_{PATIENT}")
    return {n: _keep(db, n, df, enough, PATIENT) for n, df in tables.items()}


def _named(db: Database, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Mapped columns under their common names; other columns that would clash take the table's name."""
    out: dict[str, DataFrame] = {}
    renames: dict[str, dict[str, str]] = {}
    for name, df in tables.items():
        keys = {m[name]: p for p, m in db.maps.items() if name in m}
        renames[name] = {c: keys.get(c) or (f"{c}.{name}" if c in LEVELS[VISIT] + (DATE,) else c) for c in df.columns}
    plain = [c for n in tables for c, to in renames[n].items() if to == c and to not in (PATIENT, VISIT, DATE)]
    for name, df in tables.items():
        seen: set[str] = set()
        cols = []
        for c, to in renames[name].items():
            if to == c and plain.count(c) > 1:
                to = f"{c}.{name}"
            base, k = to, 1
            while to in seen:
                to, k = f"{base}.{k}", k + 1
            seen.add(to)
            cols.append(F.col(f"`{c}`").alias(to))
        out[name] = df.select(*cols)
    return out


def _join_all(tables: dict[str, DataFrame]) -> tuple[DataFrame, list[tuple[str, str, DataFrame, DataFrame]]]:
    names = list(tables)
    steps = []
    out = tables[names[0]]
    for n in names[1:]:
        right = tables[n]
        by = [k for k in (PATIENT, VISIT, DATE) if k in out.columns and k in right.columns]
        if not by:
            raise ValueError(f"{n} shares no key with the tables before it")
        r = right.select(*[F.col(f"`{c}`").alias(f"{c}_r" if c in by else c) for c in right.columns])
        joined = out.join(r, [out[k].eqNullSafe(r[f"{k}_r"]) for k in by], "full_outer")
        cols = [F.coalesce(k, f"{k}_r").alias(k) for k in by]
        cols += [F.col(f"`{c}`") for c in [*out.columns, *right.columns] if c not in by]
        nxt = joined.select(*cols)
        steps.append((n, ",".join(by), out, nxt))
        out = nxt
    return out, steps


def _counts(step: str, before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(step, table, n_before, n_after, n_removed), lazily."""
    rows = []
    for n in before:
        b = before[n].agg(F.count("*").alias("n_before"))
        a = after[n].agg(F.count("*").alias("n_after"))
        rows.append(b.join(a, F.lit(True)).select(F.lit(step).alias("step"), F.lit(n).alias("table"), "n_before", "n_after", (F.col("n_before") - F.col("n_after")).alias("n_removed")))
    return reduce(DataFrame.unionAll, rows)


def screen_data_list(
    tables: dict[str, DataFrame],
    entry: Rule,
    entry_level: str = PATIENT,
    anchor: Rule | None = None,
    anchor_level: str = DATE,
    anchor_window: str = "from_first_anchor",
    patient_id_map=PATIENT,
    visit_id_map=None,
    date_map=None,
    followup_min_visits: int | None = None,
    followup_table: str | None = None,
    output: str = "list",
    return_audit: bool = False,
) -> ScreenResult:
    """Rows of all tables that belong to the keys chosen by entry, from each patient's first anchor on.

    output: "list" gives the tables, "joined" their full join on the keys that neighbours share
    (null keys match); that needs keys unique in every input table, which is checked first.
    Everything else is one lazy plan; audit frames count only when they are read.
    """
    if entry_level not in LEVELS or anchor_level not in (VISIT, DATE) or anchor_window not in ("from_first_anchor", "none") or output not in ("list", "joined"):
        raise ValueError("unknown level, window or output")
    db = Database(tables, patient_id_map, visit_id_map, date_map)
    if output == "joined":
        for n, df in db.tables.items():
            keys = [m[n] for m in db.maps.values() if n in m]
            if df.groupBy(*keys).count().where("count > 1").limit(1).count():
                raise ValueError(f"{n}: keys are not unique")
    audit: dict[str, DataFrame] = {}
    chosen = satisfied(db, db.tables, entry, entry_level)
    now = {n: _keep(db, n, df, chosen, entry_level) for n, df in db.tables.items()}
    audit["entry_scope"] = _counts("entry", db.tables, now)
    if anchor is not None and anchor_window != "none":
        if anchor_level == DATE and not db.maps[DATE]:
            warnings.warn("no date columns: the anchor goes by visit", stacklevel=2)
            anchor_level = VISIT
        if not db.maps[anchor_level]:
            raise ValueError(f"no table has a column for {anchor_level}")
        before, now = now, _anchor(db, now, anchor, anchor_level)
        audit["anchor_scope"] = _counts("anchor", before, now)
    if followup_min_visits:
        table = followup_table or next((n for n in tables if n in db.maps[VISIT]), None)
        if table is None or table not in db.maps[VISIT]:
            raise ValueError("follow-up needs a table with visits")
        before, now = now, _followup(db, now, table, followup_min_visits)
        audit["followup"] = _counts("followup", before, now)
    if output == "list":
        return ScreenResult(now, audit if return_audit else {})
    joined, steps = _join_all(_named(db, now))
    if steps:
        rows = []
        for n, by, before_df, after_df in steps:
            b, a = before_df.agg(F.count("*").alias("n_before")), after_df.agg(F.count("*").alias("n_after"))
            rows.append(b.join(a, F.lit(True)).select(F.lit("join").alias("step"), F.lit(n).alias("table"), F.lit(by).alias("by"), "n_before", "n_after"))
        audit["join"] = reduce(DataFrame.unionAll, rows)
    return ScreenResult(joined, audit if return_audit else {})
