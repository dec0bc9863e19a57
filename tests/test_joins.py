from datetime import date

import pytest

from clinloom.operators import range_join
from clinloom.operators import screening as S
from clinloom.operators.range_join import merge_by_range
from clinloom.operators.substring_join import merge_by_substring


def d(m, day):
    return date(2024, m, day)


def test_plain_ranges(spark):
    x = spark.createDataFrame([(1, "A", d(1, 1), d(1, 10), "W1"), (1, "B", d(2, 1), d(2, 10), "W2"), (2, "A", d(3, 1), d(3, 5), "W3")], "pid int, vid string, a date, b date, ward string")
    y = spark.createDataFrame([(1, "A", d(1, 1), "CT"), (1, "B", d(2, 10), "MRI"), (1, "B", d(2, 11), "US"), (2, "A", d(3, 3), "XR")], "pid int, vid string, day date, exam string")
    out = merge_by_range(x, y, ["pid", "vid"], "a", "b", "day", all_y=False)
    assert sorted((r.exam, r.ward, r.since_start) for r in out.collect()) == [("CT", "W1", 0), ("MRI", "W2", 9), ("XR", "W3", 2)]
    kept = merge_by_range(x, y, ["pid", "vid"], "a", "b", "day")
    assert [(r.pid, r.ward) for r in kept.where("exam = 'US'").collect()] == [(None, None)]
    assert ".cp_y_row_id" not in kept.columns


def test_relaxed(spark):
    x = spark.createDataFrame([(1, 1.0, 4.0, "left"), (1, 6.0, 8.0, "right")], "g int, s double, e double, name string")
    y = spark.createDataFrame([(1, 5.0)], "g int, v double")
    assert [(r.name, r.since_start) for r in merge_by_range(x, y, "g", "s", "e", "v", (1, 1)).collect()] == [("right", -1)]
    for width in (None, 2.0):
        p = spark.createDataFrame([(1, 1.0, "a"), (1, 4.0, "b1"), (1, 4.0, "b2"), (1, 8.0, "c")], "g int, s double, name string")
        q = spark.createDataFrame([(1, v) for v in (2.0, 4.0, 5.0, 8.0)], "g int, v double")
        out = merge_by_range(p, q, "g", "s", None, "v", (0, float("inf")), keep_row_id=True, bin_width=width)
        assert sorted((r.v, r.name, r.since_start) for r in out.collect()) == [(2, "a", 1), (4, "b1", 0), (4, "b2", 0), (5, "b1", 1), (5, "b2", 1), (8, "c", 0)]


def test_several_matches_are_numbered(spark):
    x = spark.createDataFrame([(1, 1.0, 4.0), (1, 1.0, 4.0)], "g int, s double, e double")
    y = spark.createDataFrame([(1, 2.0)], "g int, v double")
    with pytest.warns(UserWarning):
        out = merge_by_range(x, y, "g", "s", "e", "v", (1, 1))
    assert out.count() == 2 and ".cp_y_row_id" in out.columns


def test_renamed_keys_and_suffixes(spark):
    x = spark.createDataFrame([(1, 10, 15, "A"), (2, 20, 25, "B")], "patient_id int, s int, e int, kind string")
    y = spark.createDataFrame([(1, 12, "same"), (3, 99, "other")], "pid int, v int, kind string")
    rows = merge_by_range(x, y, {"x": "patient_id", "y": "pid"}, "s", "e", "v").orderBy("v").collect()
    assert [(r["kind.x"], r["kind.y"], r.s, r.since_start) for r in rows] == [("A", "same", 10, 2), (None, "other", None, None)]


def test_wrong_ranges(spark):
    x = spark.createDataFrame([(1, 5, 4)], "g int, s int, e int")
    y = spark.createDataFrame([(1, 2)], "g int, v int")
    with pytest.raises(ValueError):
        merge_by_range(x, y, "g", "s", "e", "v")
    with pytest.raises(ValueError):
        merge_by_range(x, y, "g", "s", "e", "v", (-1, 0))
    with pytest.raises(ValueError):
        merge_by_range(x, y, "zz", "s", "e", "v")


def test_substrings(spark):
    data = spark.createDataFrame([("AB",), ("B,C",), ("A..",), ("ACD",), (None,)], "name string")
    keys = spark.createDataFrame([("A", "cat1"), ("B", "cat2"), ("C", "cat3"), ("ACD", "cat4"), ("AB", "cat1"), (None, "z")], "k string, cat string")
    out = merge_by_substring(data, keys, "name", "k", ["cat"])
    count = {}
    for r in out.collect():
        count[r.name] = count.get(r.name, 0) + 1
    assert count == {"A..": 1, "AB": 2, "ACD": 3, "B,C": 2, None: 1}
    literal = spark.createDataFrame([("A.B", "cat1"), ("A+B", "cat2")], "k string, cat string")
    names = spark.createDataFrame([("A.B",), ("A+B",), ("A?B",), ("A*B",)], "name string")
    assert sorted(map(tuple, merge_by_substring(names, literal, "name", "k", ["cat"]).collect()), key=str) == sorted([("A.B", "cat1"), ("A+B", "cat2"), ("A?B", None), ("A*B", None)], key=str)
    assert merge_by_substring(names, literal.limit(0), "name", "k", ["cat"]).columns == ["name"]


@pytest.fixture(scope="module")
def cohort(spark):
    return {
        "admission": spark.createDataFrame([(1, 11, 1), (1, 12, 5), (2, 20, 1), (2, 21, 2), (2, 22, 8), (3, 31, 3)], "pid long, vid long, day long"),
        "diagnosis": spark.createDataFrame([(1, 11, 1, "I10"), (2, 21, 2, "I10"), (3, 31, 3, "J18")], "pid long, vid long, day long, icd string"),
        "lab": spark.createDataFrame([(1, 11, 1, 9.8), (1, 12, 5, 10.6), (2, 20, 1, 6.0), (2, 21, 2, 10.7), (2, 22, 8, 9.1), (3, 31, 3, 8.6)], "pid long, vid long, day long, Hb double"),
    }


MAPS = {"patient_id_map": "pid", "visit_id_map": "vid", "date_map": "day"}


def ids(df, c="vid"):
    return sorted({r[c] for r in df.collect()})


def test_entry_and_anchor(spark, cohort):
    r = S.screen_data_list(cohort, S.any_("diagnosis", "icd = 'I10'"), anchor=S.any_("lab", "Hb > 10"), return_audit=True, **MAPS)
    assert ids(r.data["admission"]) == ids(r.data["lab"]) == [12, 21, 22]
    assert {x.table: (x.n_before, x.n_after) for x in r.audit["entry_scope"].collect()} == {"admission": (6, 5), "diagnosis": (3, 2), "lab": (6, 5)}
    v = S.screen_data_list(cohort, S.any_("diagnosis", "icd = 'I10'"), anchor=S.any_("diagnosis", "icd = 'I10'"), anchor_level=S.VISIT, **MAPS)
    assert ids(v.data["lab"]) == [11, 12, 21, 22]
    assert ids(S.screen_data_list(cohort, S.any_("diagnosis", "icd = 'I10'"), followup_min_visits=3, **MAPS).data["lab"], "pid") == [2]


def test_joined(spark, cohort):
    r = S.screen_data_list(cohort, S.any_("diagnosis", "icd = 'I10'"), anchor=S.any_("lab", "Hb > 10"), output="joined", return_audit=True, **MAPS)
    assert sorted(tuple(x) for x in r.data.select("patient_id", "visit_id", "date", "icd", "Hb").collect()) == [(1, 12, 5, None, 10.6), (2, 21, 2, "I10", 10.7), (2, 22, 8, None, 9.1)]
    twice = cohort | {"lab": cohort["lab"].unionAll(cohort["lab"])}
    with pytest.raises(ValueError):
        S.screen_data_list(twice, S.any_("lab", "Hb > 1"), output="joined", **MAPS)


def test_terms(spark):
    lab = spark.createDataFrame([(1, 11, 11.0), (1, 12, None), (2, 21, 9.8), (2, 22, 9.9), (3, 31, 10.5), (3, 32, 10.7), (4, 41, None)], "pid long, vid long, Hb double")

    def run(rule, level=S.PATIENT):
        return ids(S.screen_data_list({"lab": lab}, rule, level, patient_id_map="pid", visit_id_map="vid").data["lab"], "pid")

    assert run(S.agg_("lab", "mean", "Hb", na_rm=True) > 10) == [1, 3]
    assert run(S.agg_("lab", "mean", "Hb") > 10) == [3]
    assert run(S.agg_("lab", "sum", "Hb", na_rm=True) < 12) == [1, 4]
    assert run(S.agg_("lab", "max", "Hb", na_rm=True) < 5) == [4]
    assert run(S.all_("lab", "Hb > 10")) == [3]
    assert run(S.all_("lab", "Hb < 10") | S.any_("lab", "Hb > 10.9")) == [1, 2]
    assert run(S.row_("lab", "Hb > 10"), S.VISIT) == [1, 3]
    with pytest.raises(Exception):
        run(S.row_("lab", "Hb > 10"))
    with pytest.raises(ValueError):
        run(S.any_("none", "Hb > 10"))


def test_rules_as_text(spark, cohort):
    from clinloom.operators.screen_text import parse_rule

    def run(text, table="lab"):
        return ids(S.screen_data_list(cohort, parse_rule(text, cohort), patient_id_map="pid", visit_id_map="vid").data[table], "pid")

    assert run('any(icd == "I10") & any(Hb > 10)') == [1, 2]
    assert run("any(icd == 'J18') || mean(Hb, na.rm = TRUE) > 10") == [1, 3]
    assert run("10 < mean(Hb)") == [1]
    assert run('!any(icd == "I10")') == [3]
    assert run('all(icd %in% c("I10", "J18") & !is.na(icd)) && max(Hb) - min(Hb) > 1') == [2]
    for bad in ("any(zz > 1)", "any(pid > 1)", "any(Hb >", "any(1 > 0)"):
        with pytest.raises(ValueError):
            parse_rule(bad, cohort)


@pytest.mark.parametrize("keys", [[], ["g"]])
@pytest.mark.parametrize("all_y", [False, True])
def test_rows_of_one_time_are_matched_together(spark, monkeypatch, keys, all_y):
    monkeypatch.setattr(range_join, "TOGETHER", 3)
    monkeypatch.setattr(range_join, "PAIRS", 20)
    xs = [(i % 2, float(i // 4), float(i // 4 + i % 3), i) for i in range(40)]
    ys = [(i % 2, float(i % 13), i) for i in range(130)] + [(0, None, 130), (None, 3.0, 131)]
    x, y = spark.createDataFrame(xs, "g int, s double, e double, a int"), spark.createDataFrame(ys, "g int, v double, b int")
    want = sorted((a, b, v - s) for g, s, e, a in xs for h, v, b in ys if v is not None and s <= v <= e and (not keys or g == h))
    out = merge_by_range(x, y, keys, "s", "e", "v", all_y=all_y, keep_row_id=True, bin_width=2.0).collect()
    assert sorted((r.a, r.b, r.since_start) for r in out if r.a is not None) == want
    alone = {b for _, _, b in ys} - {b for _, b, _ in want}
    assert sorted(r.b for r in out if r.a is None) == (sorted(alone) if all_y else [])
    assert len({(r.b, r[".cp_y_row_id"]) for r in out}) == len({r.b for r in out}) == len({r[".cp_y_row_id"] for r in out})


def test_pairs_of_equal_times_stay_small_in_files(spark, tmp_path):
    e = spark.range(0, 96 * 50, numPartitions=1).selectExpr("id", "cast(id % 50 * 37 % 50 as double) as t")
    x, y = e.selectExpr("id as a", "t as s", "t + 1 as e"), e.selectExpr("id as b", "t as v")
    merge_by_range(x, y, [], "s", "e", "v", all_y=False, keep_row_id=False, bin_width=25.0).select("a", "b", "since_start").write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 96 * 96 * 99
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 0.5 * 96 * 96 * 99
