"""One small frame per missing-value rule."""

import math

from pyspark.sql import functions as F

from tenfold.functions import nulls
from tenfold.functions import recode as rc
from tenfold.operators import joins


def values(df):
    return [tuple(r) for r in df.collect()]


def test_unknown_condition_gives_unknown(spark):
    df = spark.createDataFrame([(1,), (0,), (None,)], "x int")
    got = df.select(nulls.if_known(F.col("x") == 1, F.lit("a"), F.lit("b")), nulls.flag(F.col("x") == 1))
    assert values(got) == [("a", 1), ("b", 0), (None, None)]


def test_case_when_treats_unknown_as_no_match(spark):
    df = spark.createDataFrame([("5",), ("1",), ("V",), (None,)], "f string")
    assert values(df.select(rc.stem_field(F.col("f")))) == [("STEM",), ("Non-STEM",), (None,), (None,)]


def test_employment_flags_follow_three_valued_logic(spark):
    rows = [("1", None), ("2", "1"), ("2", None), (None, "1"), (None, "2"), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = values(df.select(rc.employed_by_work(F.col("a"), F.col("b"))))
    # A missing first answer is FALSE by the explicit guard; a missing second stays unknown unless decided.
    assert got == [(1,), (1,), (None,), (1,), (0,), (None,)]


def test_any_reason_decides_even_with_missing(spark):
    df = spark.createDataFrame([("1", None), ("2", None), ("2", "2")], "a string, b string")
    assert values(df.select(rc.out_of_labour_force([F.col("a"), F.col("b")]))) == [(1,), (None,), (0,)]


def test_negated_membership_keeps_missing(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert values(df.where(nulls.not_member(F.col("x"), ["a"]))) == [("b",), (None,)]
    assert values(df.where(nulls.is_member(F.col("x"), ["a"]))) == [("a",)]


def test_lookup_join_matches_missing_keys(spark):
    df = spark.createDataFrame([(1,), (None,), (9,)], "k int")
    dim = spark.createDataFrame([(1, "one"), (None, "none")], "key int, v string")
    got = joins.lookup_join(df, dim, "k", "key")
    assert got.columns == ["k", "v"]
    assert sorted(values(got), key=str) == sorted([(1, "one"), (None, "none"), (9, None)], key=str)
    # The same beyond the broadcast bound.
    wide = joins.lookup_join(df, dim, "k", "key", max_rows=1)
    assert sorted(values(wide), key=str) == sorted(values(got), key=str)


def test_duplicate_lookup_keys(spark):
    df = spark.createDataFrame([(1,)], "k int")
    dim = spark.createDataFrame([(1, "a"), (1, "b")], "key int, v string")
    assert joins.lookup_join(df, dim, "k", "key").count() == 2
    try:
        joins.lookup_join(df, dim, "k", "key", unique=True)
    except ValueError:
        return
    raise AssertionError("duplicate keys went unnoticed")


def test_anti_join_drops_missing_only_if_listed(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "x string")
    plain = spark.createDataFrame([("a",)], "y string")
    with_missing = spark.createDataFrame([("a",), (None,)], "y string")
    assert sorted(values(joins.drop_listed(df, "x", plain, "y")), key=str) == sorted([(None,), ("b",)], key=str)
    assert values(joins.drop_listed(df, "x", with_missing, "y")) == [("b",)]


def test_text_to_number(spark):
    df = spark.createDataFrame([("1.5",), ("V",), ("",), (None,), (" 2 ",), ("NaN",), ("1d",), ("1e3",)], "x string")
    assert [r[0] for r in df.select(nulls.to_number(F.col("x"))).collect()] == [1.5, None, None, None, 2.0, None, None, 1000.0]


def test_null_tokens(spark):
    df = spark.createDataFrame([("NA", 1.0), ("", math.nan), ("x", None)], "s string, d double")
    assert values(nulls.null_tokens(df, ("NA", ""))) == [(None, 1.0), (None, None), ("x", None)]
    assert values(nulls.null_tokens(df, ("NA",))) == [(None, 1.0), ("", None), ("x", None)]


def test_blank_nulls(spark):
    df = spark.createDataFrame([(None, 1), ("a", None)], "s string, i int")
    assert values(nulls.blank_nulls(df)) == [("", "1"), ("a", "")]


def test_ratio_at_zero(spark):
    df = spark.createDataFrame([(1, 0), (1, 2)], "a int, b int")
    assert values(df.select(nulls.ratio(F.col("a"), F.col("b")))) == [(None,), (0.5,)]


def test_plausibility_rules(spark):
    rows = [(0.05, "Employed"), (0.1, "Employed"), (500.0, "Employed"), (501.0, "Employed"), (5.0, "Unemployed"), (None, "Employed"), (5.0, None)]
    df = spark.createDataFrame(rows, "e double, s string")
    got = [r[0] for r in df.select(rc.plausible_earnings(F.col("e"), F.col("s"))).collect()]
    assert got == [None, 0.1, 500.0, None, None, None, None]
    rows = [(0.0, "Employed", "25to29"), (0.0, "Unemployed", "25to29"), (13.0, "Employed", "25to29"), (14.0, "Employed", "25to29"),
            (18.0, "Employed", "30to34"), (19.0, "Employed", "30to34"), (None, "Employed", "30to34")]
    df = spark.createDataFrame(rows, "x double, s string, a string")
    got = [r[0] for r in df.select(rc.experience_flag(F.col("x"), F.col("s"), F.col("a"))).collect()]
    assert got == ["other", "Yes", "Yes", "other", "Yes", "other", "other"]


def test_recode_default(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "x string")
    assert values(df.select(rc.recode(F.col("x"), {"a": 1}), rc.recode_text(F.col("x"), {"a": "b"}))) == [(1, "b"), (None, "z"), (None, None)]


def test_levels_and_reference(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "x string")
    assert rc.factor_levels(df, ["x"]) == {"x": ["a", "b", "c"]}
    assert rc.factor_levels(df, ["x"], {"x": "c"}) == {"x": ["c", "a", "b"]}
