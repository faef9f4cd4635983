"""Odd uploads: no rows, no numeric columns, awkward column names."""

from pyspark.sql import functions as F

from tabulon.operators import clean as C
from tabulon.operators import profile as P
from tabulon.operators import stats as S
from tabulon.plans import workflows as W


def test_empty_table(spark):
    df = spark.createDataFrame([], "a long, b string, c double")
    prof = P.profile_columns(df)
    assert [p.semantic_type for p in prof] == ["empty", "empty", "empty"]
    assert C.fill_median(df)[0].count() == 0
    assert C.tukey_filter(df).frame.count() == 0
    assert S.histogram(df).count() == 0
    rows = S.column_summary(df).collect()
    assert len(rows) == 2 and all(r["count"] == 0 and r["missing_pct"] is None for r in rows)
    assert P.missing_report(df).count() == 3 and S.value_counts(df, ["b"]).count() == 0


def test_text_only_table(spark):
    df = spark.createDataFrame([("x", "y"), ("x", None), ("z", "y")], "a string, b string")
    assert S.column_summary(df).count() == 0 and S.corr_matrix(df).count() == 0
    filled, modes = C.fill_mode(df)
    assert modes == {"b": "y"} and filled.where(F.col("b").isNull()).count() == 0
    out = W.sql_pack(df, table="text_only", collect=True)
    assert out["queries"]["overview"].rows == [{"total_rows": 3}]


def test_awkward_names(spark):
    df = spark.createDataFrame([(1.0, "a", 10.0), (2.0, "b", None), (300.0, "a", 12.0)],
                               "`unit.price` double, `the cat` string, `sales $` double")
    df = df.toDF("unit.price", "the cat", "sales $")
    s = {r["column"]: r for r in S.column_summary(df).collect()}
    assert set(s) == {"unit.price", "sales $"}
    filled, med = C.fill_median(df)
    assert med == {"sales $": 11.0}
    assert S.value_counts(df, ["the cat"], 1).first()["value"] == "a"
    assert S.histogram(df, ["unit.price"]).count() == 20
    assert P.missing_report(df).where(F.col("column") == "sales $").first()["n_missing"] == 1
