import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import clean as C
from tabulon.operators import profile as P
from tabulon.operators import stats as S
from tabulon.operators.quantiles import quantiles


@pytest.fixture(scope="module")
def noisy(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(400):
        v = None if i % 9 == 0 else (rnd.gauss(50, 10) if i % 37 else 5000.0)
        cat = None if i % 11 == 0 else rnd.choice(["a", "b", "c"])
        rows.append((i % 200, v, cat, 7))
    return spark.createDataFrame(rows, "k long, v double, cat string, const int")


def test_quantiles_match_numpy(spark):
    rnd = random.Random(3)
    vals = [rnd.choice([1.0, 2.0, 2.0, 3.5]) if i % 3 else rnd.uniform(-1e6, 1e6) for i in range(5000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = quantiles(df, ["x"], probs)["x"]
    want = np.quantile(np.array(vals), probs)
    assert all(math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-9) for a, b in zip(got, want))


def test_quantiles_heavy_ties(spark):
    # one value holds far more than a third of all rows
    df = spark.range(30000).select(F.when(F.col("id") % 3 != 0, F.lit(42.0)).otherwise(F.col("id") / 7).alias("x"))
    vals = np.array([42.0 if i % 3 else i / 7 for i in range(30000)])
    got = quantiles(df, ["x"], [0.1, 0.5, 0.9])["x"]
    assert np.allclose(got, np.quantile(vals, [0.1, 0.5, 0.9]))


def test_dedup_idempotent(noisy):
    once = C.drop_duplicates(noisy)
    assert once.count() == C.drop_duplicates(once).count() == noisy.distinct().count()


def test_impute_leaves_no_nulls(noisy):
    filled, fills = C.impute_basic(noisy)
    row = filled.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in filled.columns]).first()
    assert all(v == 0 for v in row.asDict().values())
    assert fills["cat"] in ("a", "b", "c")
    pdf = noisy.toPandas()
    assert math.isclose(fills["v"], pdf["v"].median())


def test_mode_ties_to_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "s string")
    assert C.fill_mode(df)[1]["s"] == "a"
    empty = spark.createDataFrame([(None,), (None,)], "s string")
    assert C.fill_mode(empty)[1]["s"] == "Unknown"


def test_tukey_matches_pandas(noisy):
    pdf = noisy.toPandas()
    for col in ["k", "v", "const"]:
        q1, q3 = pdf[col].quantile(0.25), pdf[col].quantile(0.75)
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        if ((pdf[col] < lo) | (pdf[col] > hi)).sum() > 0:
            pdf = pdf[(pdf[col] >= lo) & (pdf[col] <= hi)]
    got = C.tukey_filter(noisy).frame
    assert got.count() == len(pdf)


def test_wide_fence_drops_nulls(noisy):
    res = C.wide_fence_filter(noisy, ["v"])
    assert res.frame.where(F.col("v").isNull()).count() == 0


def test_sparse_and_constant(spark):
    df = spark.createDataFrame([(i, None if i % 10 else 1, 3) for i in range(20)], "a long, b int, c int")
    assert C.drop_sparse(df)[1] == ["b"]
    assert C.drop_zero_variance(df)[1] == ["b", "c"]


def test_profile_types(spark):
    df = spark.createDataFrame(
        [(i, f"2024-01-{(i % 28) + 1:02d}", str(i % 2), "t" + str(i), "x" if i % 3 else "y", None)
         for i in range(40)], "n long, d string, b string, t string, c string, e string")
    types = P.semantic_types(df)
    assert types == {"n": "numeric", "d": "datetime", "b": "binary", "t": "text", "c": "categorical", "e": "empty"}


def test_quality_score():
    assert P.quality_score(100, 0, 0, 100, 5) == 100
    assert P.quality_score(100, 10, 0, 90, 5) == 95
    assert P.quality_score(100, 50, 1000, 50, 5) == 60


def test_histogram_counts_sum(noisy):
    h = S.histogram(noisy, ["v", "const"]).collect()
    assert sum(r["count"] for r in h if r["column"] == "v") == noisy.where(F.col("v").isNotNull()).count()
    assert len([r for r in h if r["column"] == "const"]) == 20
    pdf = noisy.toPandas()
    counts, edges = np.histogram(pdf["v"].dropna(), bins=20)
    got = sorted((r["bin"], r["count"]) for r in h if r["column"] == "v")
    assert [c for _, c in got] == list(counts)


def test_corr_symmetric(noisy):
    rows = S.corr_matrix(noisy, ["k", "v", "const"], digits=None).collect()
    m = {(r["col_a"], r["col_b"]): r["corr"] for r in rows}
    assert m[("k", "v")] == m[("v", "k")]
    assert m[("const", "k")] is None
    pdf = noisy.toPandas()
    assert math.isclose(m[("k", "v")], pdf["k"].corr(pdf["v"]), rel_tol=1e-9)


def test_value_counts_top_k(noisy):
    vc = S.value_counts(noisy, ["cat"], 2).collect()
    assert len(vc) == 2 and vc[0]["count"] >= vc[1]["count"]


def test_summary_and_box(noisy):
    s = {r["column"]: r for r in S.column_summary(noisy, ["v"]).collect()}
    pdf = noisy.toPandas()
    assert math.isclose(s["v"]["std"], round(pdf["v"].std(), 4))
    assert math.isclose(s["v"]["median"], round(pdf["v"].median(), 4))
    b = S.box_data(noisy, "v").first()
    assert b["n_outliers"] >= 1


def test_opt_in_sketches(spark, noisy):
    approx = quantiles(noisy, ["v"], [0.25, 0.75], exact=False)["v"]
    exact = quantiles(noisy, ["v"], [0.25, 0.75])["v"]
    assert all(abs(a - b) < 2.0 for a, b in zip(approx, exact))
    assert C.tukey_filter(noisy, ["v"], exact=False).frame.count() > 0
    prof = {p.column: p.n_distinct for p in P.profile_columns(noisy, exact=False)}
    assert prof["const"] == 1 and prof["cat"] == 3


from hypothesis import given, settings, strategies as st  # noqa: E402


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50).map(float), st.floats(-1e6, 1e6)), min_size=1, max_size=300),
       st.sampled_from([0.0, 0.1, 0.5, 0.9, 1.0]))
def test_quantiles_property(spark, vals, p):
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = quantiles(df, ["x"], [p])["x"][0]
    present = [v for v in vals if v is not None]
    if not present:
        assert got is None
    else:
        assert math.isclose(got, float(np.quantile(np.array(present), p)), rel_tol=1e-9, abs_tol=1e-9)
