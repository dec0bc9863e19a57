"""Bringing the values of a subject to one unit."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinloom.functions.aggregates import first_mode
from clinloom.functions.numbers import as_numeric, extract_num
from clinloom.functions.text import value_initial_cleaning


@dataclass(frozen=True)
class UnitRule:
    """units2change maps units (None: missing) to coefficients; units2remove blanks values."""

    subject: str
    target_unit: str | None = None
    units2change: dict = field(default_factory=dict)
    units2remove: tuple = ()

    def __post_init__(self):
        if not self.subject:
            raise ValueError("a rule needs a subject")
        roles = [*self.units2change, *self.units2remove, *([self.target_unit] if self.target_unit is not None else [])]
        if len(set(roles)) != len(roles):
            raise ValueError(f"{self.subject}: a unit has two roles")


def rules_from_table(rows: list[tuple[str, str | None, str | float | None]]) -> list[UnitRule]:
    """Rules from (subject, unit, label): label t is the target, r removes, a number converts, null says nothing."""
    by: dict[str, dict] = {}
    for subject, unit, label in rows:
        if label is None:
            continue
        r = by.setdefault(subject, {"target": [], "change": {}, "remove": []})
        if unit in r["change"] or unit in r["remove"] or unit in r["target"]:
            raise ValueError(f"{subject}: unit {unit} is listed twice")
        if label == "t":
            r["target"].append(unit)
        elif label == "r":
            r["remove"].append(unit)
        else:
            r["change"][unit] = float(label)
    if any(len(r["target"]) > 1 for r in by.values()):
        raise ValueError("a subject has several targets")
    return [UnitRule(s, r["target"][0] if r["target"] else None, r["change"], tuple(r["remove"])) for s, r in by.items()]


def unit_standardize(df: DataFrame, subject_col: str, value_col: str, unit_col: str, rules: list[UnitRule], extract_numbers: bool = False, order_by: str | None = None) -> DataFrame:
    """Values converted by their subject's rule; the whole subject then bears the target unit.

    Without a target the most frequent unit that is not being changed is taken (an error if there is none; one more job); a subject with
    one unit and no target is left alone. Units that no rule names take the target's name
    without conversion. Rules are a small table that joins on subject and unit.
    """
    spark = df.sparkSession
    kind = dict(df.dtypes)[value_col]
    if kind != "string":
        value = F.col(value_col).cast("double")
    else:
        clean = value_initial_cleaning(F.col(value_col))
        value = extract_num(clean) if extract_numbers else as_numeric(clean)
    out = df.withColumn(value_col, value)
    if not rules:
        return out
    if len({r.subject for r in rules}) != len(rules):
        raise ValueError("a subject has several rules")
    change = [(r.subject, u, float(k), False) for r in rules for u, k in r.units2change.items()] + [(r.subject, u, None, True) for r in rules for u in r.units2remove]
    change_df = spark.createDataFrame(change, "_s string, _u string, _k double, _rm boolean")
    targets = spark.createDataFrame([(r.subject, r.target_unit) for r in rules], "_ts string, _t string")
    open_ = [r for r in rules if r.target_unit is None]
    if open_:
        mine = df.join(spark.createDataFrame([(r.subject,) for r in open_], "_os string"), F.col(subject_col) == F.col("_os"), "left_semi")
        several = mine.groupBy(subject_col).agg((F.count_distinct(unit_col) + F.max(F.col(unit_col).isNull().cast("int"))).alias("_n")).where(F.col("_n") > 1).select(F.col(subject_col).alias("_ms"))
        other = mine.join(change_df, (F.col(subject_col) == F.col("_s")) & F.col(unit_col).eqNullSafe(F.col("_u")), "left_anti").where(F.col(unit_col).isNotNull())
        common = first_mode(other, [subject_col], unit_col, order_by or unit_col, "_m").select(F.col(subject_col).alias("_cs"), "_m")
        found = several.join(common, F.col("_ms") == F.col("_cs"), "left").select(F.col("_ms").alias("_fs"), "_m")
        if bad := sorted(str(r[0]) for r in found.where(F.col("_m").isNull()).select("_fs").take(5)):
            raise ValueError(f"no target unit can be found, as all units are to be changed: {', '.join(bad)}")
        targets = targets.join(found, F.col("_ts") == F.col("_fs"), "left").where(F.col("_t").isNotNull() | F.col("_fs").isNotNull()).select("_ts", F.coalesce("_t", "_m").alias("_t"))
    out = out.join(targets, F.col(subject_col) == F.col("_ts"), "left")
    out = out.join(change_df, (F.col(subject_col) == F.col("_s")) & F.col(unit_col).eqNullSafe(F.col("_u")), "left")
    ruled = F.col("_ts").isNotNull()
    new = F.when(ruled & F.col("_rm"), None).when(ruled, F.col(value_col) * F.coalesce("_k", F.lit(1.0))).otherwise(F.col(value_col))
    out = out.withColumns({value_col: new, unit_col: F.when(ruled, F.col("_t")).otherwise(F.col(unit_col))})
    return out.select(*df.columns)
