from datetime import date

import pytest
from pyspark.sql import functions as F

from clinloom.functions import aggregates as A
from clinloom.functions import choice, dates, names, numbers, text


def col(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").coalesce(1)


def out(df, c):
    return [r[0] for r in df.orderBy("i").select(c.alias("o")).collect()]


@pytest.fixture
def X(spark):
    return F.col("x")


def test_extract_num(spark, X):
    d = col(spark, ["1.2(XXX)", "5-8POS", "NS", "FULL", "5.5", "4.2", None])
    assert out(d, numbers.extract_num(X)) == [1.2, 5, None, None, 5.5, 4.2, None]
    assert out(col(spark, ["3-5", "6"]), numbers.extract_num(X, multimatch2na=True)) == [None, 6]
    assert out(col(spark, ["0.5kg", "2.0lbs"]), numbers.extract_num(X, leq_1=True)) == [0.5, None]
    assert out(col(spark, ["3-5cm", "7.2mm", "1|3kg"]), numbers.extract_num(X, "range", allow_neg=False)) == [4, 7.2, 2]


def test_extract_num_column(spark):
    d = col(spark, ["1.2(XXX)", "1.5", "0.82", "5-8POS", "NS", "FULL"])
    got = numbers.extract_num_column(d, "x", "o", multimatch2na=True, zero_regexp="NEG|NS", max_regexp="FULL", max_quantile=0.95)
    assert [r.o for r in got.orderBy("i").collect()] == pytest.approx([1.2, 1.5, 0.82, None, 0, 1.47])
    plain = numbers.extract_num_column(col(spark, ["-1", "2"]), "x", "o", leq_1=True)
    assert [r.o for r in plain.orderBy("i").collect()] == [-1, 2]


def test_as_numeric_takes_no_suffix(spark, X):
    assert out(col(spark, ["5d", "5f", " 1e3 ", "１２", "", "."]), numbers.as_numeric(X)) == [None, None, 1000, None, None, None]


def test_dates(spark, X):
    d = col(spark, ["2020-01-01", "2020/01/01", "20200101", "2020.01.01", "44197", "2020-13-01", "not_a_date", "123456789", "2020-1-1 10:00", None])
    day = date(2020, 1, 1)
    assert out(d, dates.to_date(X)) == [day] * 4 + [date(2021, 1, 1), None, None, None, day, None]
    assert out(col(spark, [43562], "int"), dates.to_date(X, "int")) == [date(2019, 4, 7)]


def test_cleaning(spark, X):
    d = col(spark, ["１２．３", "0..45", "  67 ", "", "ａｂａｎｄｏｎ", None])
    assert out(d, text.value_initial_cleaning(X)) == ["12.3", "0.45", "67", None, "abandon", None]
    assert out(col(spark, ["<0.5", "&lt;6", "plg"]), text.value_initial_cleaning(X, remove_inequal=True)) == ["0.5", "6", "plg"]
    assert out(col(spark, ["plg<1"]), text.value_initial_cleaning(X, remove_inequal=True, strict=True)) == ["p1"]
    assert out(col(spark, ["  hello  ", "\ta  b\n", ""]), text.char_initial_cleaning(X)) == ["hello", "a b", None]


def test_recoding(spark, X):
    assert out(col(spark, ["a", "x", "1", None, "a"]), text.replace_elements(X, ["a", "b", None], ["A", "B", "XX"])) == ["A", "x", "1", "XX", "A"]
    assert out(col(spark, ["v1.v2", "v3.yy", "v4"]), text.str_match_replace(X, ["v1", "v2", "v3"], ["A", "B", "C"])) == ["A.B", "C.yy", "v4"]
    assert out(col(spark, ["aab"]), text.str_match_replace(X, ["a", "aa"], ["B", "A"])) == ["Ab"]


def test_keep_by_keyword(spark, X):
    d = col(spark, ["id:AB-2026", "id:CD-2027", "none", None])
    assert out(d, text.keep_by_keyword(X, ":|-")) == ["id:", "id:", "", None]
    assert out(d, text.keep_by_keyword(X, ":|-", "last", "end")) == ["-2026", "-2027", "", None]
    assert out(d, text.keep_by_keyword(X, ":|-", "last", "end", include_keyword=False)) == ["2026", "2027", "", None]
    assert out(d, text.keep_by_keyword(X, ":|-", "first", "last")) == [":AB-", ":CD-", "", None]
    with pytest.raises(ValueError):
        text.keep_by_keyword(X, "a", "last", "first")


def test_format_pval(spark, X):
    assert out(col(spark, [0.001, 0.0001, 0.05, 0.1123456, None], "double"), numbers.format_pval(X)) == ["0.001", "<0.001", "0.050", "0.112", ""]


def test_index_and_choices(spark):
    d = spark.createDataFrame([(0, None, 1), (1, 2, None), (2, 3, 5)], "i int, a int, b int")
    got = choice.calculate_index(F.col("a") > 2, F.col("b"), weight=[2, 3], na_replace=[0, 1])
    assert [r[0] for r in d.orderBy("i").select(got).collect()] == [3, 1, 17]
    e = spark.createDataFrame([("A", True, False, True), ("B", True, False, None)], "Q1 string, Q2_A boolean, Q2_B boolean, Q2_C boolean")
    assert [tuple(r) for r in choice.answer_check(e, ["A", "TFT"], multi_column=True).collect()] == [(True, True), (False, False)]
    f = spark.createDataFrame([(0, "ab"), (1, None), (2, "")], "i int, q string")
    g = choice.split_multichoice(f, ["q"], order_by="i").orderBy("i").collect()
    assert [(r.q_a, r.q_b) for r in g] == [(True, True), (None, None), (False, False)]
    h = spark.createDataFrame([(True, False), (None, True), (None, None)], "a1 boolean, a2 boolean")
    assert [r.a for r in choice.combine_multichoice(h, {"a": ["a1", "a2"]}).collect()] == ["1", "2", ""]
    with pytest.raises(ValueError):
        choice.combine_multichoice(h, {"a": ["zz"]})


def test_aggregates(spark, X):
    d = spark.createDataFrame([(i, v) for i, v in enumerate([None, 1.0, 2.0, None, 3.0, None, 4.0])], "i int, x double")
    r = d.agg(*[A.get_valid(X, F.col("i"), m).alias(m) for m in ("first", "mid", "last")]).first()
    assert (r["first"], r["mid"], r["last"]) == (1, 2, 4)
    assert [x.f for x in d.withColumn("g", F.lit(1)).withColumn("f", A.fill_with_last("x", "i", ["g"])).orderBy("i").collect()] == [None, 1, 2, 2, 3, 3, 4]
    m = spark.createDataFrame([("a", i, v) for i, v in enumerate([1, 1, 2, 2, 3, 3, 3, None])] + [("b", 0, 5), ("b", 1, 4), ("c", 0, None)], "g string, i int, x int")
    assert {r.g: r["mode"] for r in A.first_mode(m, ["g"], "x", "i").collect()} == {"a": 3, "b": 5, "c": None}
    dup = spark.createDataFrame([(1, None), (1, None), (2, "a")], "a int, b string")
    assert sorted(r.duplicated for r in A.indicate_duplicates(dup).collect()) == [False, True, True]


def test_names():
    assert names.merge_ordered_vectors([[1, 3, 4, 5, 7, 10], [2, 5, 6, 7, 8], [1, 7, 5, 10]]) == [1, 3, 4, 2, 5, 6, 7, 10, 8]
    assert names.merge_ordered_vectors([]) is None
    assert names.add_lists({"a": 1, "b": 2}, {"a": 3, "b": 4, "c": 5}) == {"a": 4, "b": 6, "c": 5}
    assert names.common_prefix(["Q1_a", "Q1_b"]) == "Q1_" and names.common_prefix(["x", "y"]) == ""
    assert names.vec2code(["a", None]) == "c('a', NA)" and names.vec2code([]) == "c()"
