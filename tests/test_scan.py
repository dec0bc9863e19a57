"""Scans split over tasks equal plain loops; containment join and samples equal brute force."""

import hashlib
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from clinloom.functions.aggregates import sample_values
from clinloom.operators import scan
from clinloom.operators.substring_join import merge_by_substring


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [("hot", float(k), float(rng.randint(0, 9)) if rng.random() < 0.3 else None) for k in rng.sample(range(100_000), 3000)]
    out += [("hot", 1e18, 4.0), ("b", 2.0, None), ("b", 1.0, 7.0), (None, 3.0, 1.0), (None, 5.0, None), ("c", 1.0, None)]
    return out


@pytest.mark.parametrize("keys", [["g"], []])
def test_scans_equal_loops(spark, rows, keys):
    d = spark.createDataFrame(rows, "g string, o double, x double").dropDuplicates(["o"] if not keys else ["g", "o"]).repartition(4).persist()
    p = d.toPandas()
    got = scan.last_valid(d, keys, "o", "x", "last", 16, 10)
    got = scan.max_before(got, keys, "o", "x", "top", 16, 10)
    got = scan.next_value(got, keys, "o", "o", "next", 16, 10)
    got = scan.running_sum(got.withColumn("one", F.lit(1)), keys, "o", ["one"], pieces=16, most=10)
    got = {(r.g, r.o): (r.last, r.top, r.next, r.cum_one) for r in got.collect()}
    assert len(got) == len(p)
    for _, part in p.groupby("g", dropna=False) if keys else [(None, p)]:
        last = top = None
        part = part.sort_values("o").reset_index(drop=True)
        for i, r in part.iterrows():
            x = None if pd.isna(r.x) else r.x
            last = x if x is not None else last
            g = None if pd.isna(r.g) else r.g
            assert got[g, r.o] == (last, top, part["o"][i + 1] if i + 1 < len(part) else None, i + 1)
            top = top if x is None else x if top is None else max(top, x)


def test_pieces_have_equal_shares(spark, rows):
    n = [r["count"] for r in scan.cut(spark.createDataFrame(rows, "g string, o double, x double").where("g = 'hot'"), ["g"], "o", 16, 10).groupBy("_p").count().collect()]
    assert len(n) == 16 and max(n) <= 2 * sum(n) / len(n)  # the far value is in a piece with others


@pytest.mark.parametrize("most", [2, 100])
def test_last_valid_without_a_place(spark, most):
    d = spark.createDataFrame([(None, 5.0), (1.0, None), (2.0, 3.0), (3.0, None)], "o double, x double")
    assert sorted((r.o or 0, r.f) for r in scan.last_valid(d, [], "o", "x", "f", most=most).collect()) == [(0, 5.0), (1.0, 5.0), (2.0, 3.0), (3.0, 3.0)]
    assert scan.last_valid(d.limit(0), [], "o", "x", "f").count() == 0


@pytest.mark.parametrize("keys", [["g"], []])
def test_bounds_of_ranges_split_or_not(spark, rows, keys):
    d = spark.createDataFrame(rows, "g string, o double, x double").dropDuplicates(["o"]).withColumns({"e": F.col("o") + F.pmod(F.hash("o"), F.lit(300)), "r": F.col("o") - 20})
    a, b = (sorted(map(tuple, scan.clip_bounds(d, keys, "o", "e", "r", 1e300, most).collect()), key=str) for most in (10, 10**6))
    assert a == b and len(a) > 3000


@pytest.mark.parametrize("fold", [True, False])
def test_containment_equals_brute_force(spark, fold):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abAé .*") for _ in range(rng.randint(0, 14))) for _ in range(300)] + [None, "", "ab"]
    keys = [("".join(rng.choice("abAé .*") for _ in range(rng.randint(1, 5))), f"v{k % 7}") for k in range(40)] + [("", "none"), (None, "none")]
    data = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = merge_by_substring(data, spark.createDataFrame(keys, "k string, v string"), "t", "k", ["v"], fold)
    case = str.lower if fold else str
    want = []
    for i, t in enumerate(texts):
        hit = {v for k, v in keys if k and t is not None and case(k) in case(t)} or {None}
        want += [(t, i, v) for v in hit]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    plan = out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_samples(spark):
    d = spark.createDataFrame([("a", f"v{k % 12}") for k in range(40)] + [("b", None), (None, "z"), (None, "z")], "g string, x string")
    order = sorted((f"v{k}" for k in range(12)), key=lambda v: hashlib.md5(v.encode()).hexdigest())
    one = {r.g: r.samples for r in sample_values(d, ["g"], "x", 5, True, ",").collect()}
    assert one == {"a": ",".join(order[:5]), "b": "", None: "z"}
    more = {r.g: r.samples for r in sample_values(d, ["g"], "x", 5, False, ",").collect()}
    assert more["a"] == ",".join(v for v in order for _ in range(sum(k % 12 == int(v[1:]) for k in range(40))))[: len(more["a"])] and more[None] == "z,z"


def test_units_without_a_target(spark):
    from clinloom.operators import units

    d = spark.createDataFrame([("a", 1.0, "g"), ("a", 2.0, "mg")], "s string, v double, u string")
    with pytest.raises(ValueError, match="no target unit"):
        units.unit_standardize(d, "s", "v", "u", [units.UnitRule("a", None, {"g": 2.0, "mg": 3.0})])
