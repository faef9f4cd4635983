"""Distinct counts: exact by grouped keys, by sketch where the limit is far."""

import pytest
from pyspark.sql import functions as F

from tabulon.functions import roles
from tabulon.operators import clean, distinct as D, ml, profile
from tabulon.operators import stats
from tabulon.plans import querypack


@pytest.fixture(scope="module")
def wide(spark):
    nan = float("nan")
    return spark.range(20_000).select(
        F.col("id").alias("unique"), (F.col("id") % 50).alias("fifty"), (F.col("id") % 51).cast("string").alias("type_51"), F.lit(3).alias("one"),
        F.lit(None).cast("string").alias("none"), F.when(F.col("id") % 2 == 0, nan).otherwise(0.0).alias("nans"),
        F.when(F.col("id") % 2 == 0, -0.0).otherwise(0.0).alias("zeros"), (F.col("id") % 3 == 0).alias("flag"),
        F.array((F.col("id") % 4)).alias("list"), F.concat(F.lit("c"), (F.col("id") % 50).cast("string")).alias("category"),
        F.when(F.col("id") > 5, F.concat(F.lit("t"), (F.col("id") % 9990).cast("string"))).alias("half"))


WANT = {"unique": 20000, "fifty": 50, "type_51": 51, "one": 1, "none": 0, "nans": 2, "zeros": 1, "flag": 2, "list": 4, "category": 50, "half": 9990}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exact_counts(wide):
    assert D.counted(wide, wide.columns) == WANT
    row = querypack.distinct_counts(wide).first().asDict()
    assert row == {f"{c}_unique": n for c, n in WANT.items()}
    assert "Expand" not in plan(querypack.distinct_counts(wide))
    assert set(querypack.distinct_counts(wide.limit(0)).first()) == {0}
    assert D.counted(wide, []) == {}


def test_types_need_no_exact_count_of_unique_columns(wide):
    exact, fast = profile.profile_columns(wide), profile.profile_columns(wide, exact=False)
    assert {p.column: p.n_distinct for p in exact} == WANT
    assert [p.semantic_type for p in exact] == [p.semantic_type for p in fast]
    assert [(p.n, p.n_missing, p.missing_pct) for p in exact] == [(p.n, p.n_missing, p.missing_pct) for p in fast]
    # 9990 of 19,994: near the half, so it is counted
    assert {p.column: p.semantic_type for p in fast}["half"] == "categorical" and {p.column: p.n_distinct for p in fast}["half"] == 9990
    estimates = {p.column: p.n_distinct for p in fast}
    assert D.decided(wide, estimates, {c: [50.5] for c in estimates})["unique"].exact is False


def test_limits(wide):
    assert D.few_values(wide, ["unique", "fifty", "type_51", "none"], 50) == {"unique": False, "fifty": True, "type_51": False, "none": True}
    assert roles.detect_roles(wide, "sql").category == "category"
    assert ml.detect_problem_type(wide, "fifty", {}) == "regression" and ml.detect_problem_type(wide, "flag", {}) == "classification"


def test_constant_columns(wide):
    assert D.constant_columns(wide, wide.columns) == ["one", "none", "zeros"]
    kept, gone = clean.drop_zero_variance(wide)
    assert gone == ["one", "none", "zeros"] and "unique" in kept.columns
    assert D.constant_columns(wide.limit(0), ["one", "list"]) == ["one", "list"]


def test_sums_keep_what_a_decimal_drops(spark):
    df = spark.range(100_000).select(F.when(F.col("id") == 7, 0.05).otherwise(4e-11).alias("x"), (F.col("id") * 1e14).alias("y"),
                                     F.lit(None).cast("double").alias("z"))
    got = {r["column"]: r["sum"] for r in stats.column_summary(df, digits=None).collect()}
    assert got["x"] == pytest.approx(0.05 + 99_999 * 4e-11, rel=1e-12) and got["y"] == pytest.approx(1e14 * 99_999 * 50_000) and got["z"] is None


def test_half_even(spark):
    df = spark.createDataFrame([("a", 0.125), ("b", 0.375)], "k string, v double")
    assert {r["k"]: r["total"] for r in stats.group_top_k(df, "k", "v").collect()} == {"a": 0.12, "b": 0.38}


def test_codes_are_no_numbers(spark):
    df = spark.createDataFrame([("12F",), ("7D",), ("1e3",), ("x",), (None,)], "v string")
    assert [r["v"] for r in clean.coerce_numeric(df, ["v"]).collect()] == [None, None, 1000.0, None, None]
