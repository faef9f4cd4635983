import datetime
import math
import os
import tempfile

from pyspark.sql import functions as F

from tabulon.functions.numeric import nan_to_null
from tabulon.functions.roles import detect_roles
from tabulon.operators import ml
from tabulon.plans import adhoc as AD
from tabulon.plans.querypack import run_pack
from tabulon.sources.csv import limit_rows
from tabulon.sources.sinks import export_pack_sql, pack_sql_text


def test_nan_inf_to_null(spark):
    df = spark.createDataFrame([(1.0, 1), (float("nan"), 2), (float("inf"), 3), (-float("inf"), 4)], "x double, k int")
    out = sorted(nan_to_null(df).collect(), key=lambda r: r["k"])
    assert [r["x"] for r in out] == [1.0, None, None, None]
    assert nan_to_null(df).schema == df.schema


def test_adhoc_gate_and_cap(spark, demo):
    assert AD.is_query("  select 1") and AD.is_query("WITH t AS (SELECT 1) SELECT * FROM t")
    assert AD.is_query("-- note\n(SELECT 1)")
    assert not AD.is_query("DROP TABLE x") and not AD.is_query("SELECT 1; DROP TABLE x")
    assert not AD.is_query("INSERT INTO t SELECT 1")
    r = AD.run_custom_query(spark, "SELECT * FROM demo_adhoc", {"demo_adhoc": demo}, row_cap=5)
    assert r.error is None and len(r.rows) == 5 and r.row_count == 16 and r.columns[0] == "Product"
    bad = AD.run_custom_query(spark, "DELETE FROM demo_adhoc")
    assert bad.error == "Only SELECT queries allowed"
    err = AD.run_custom_query(spark, "SELECT nope FROM demo_adhoc")
    assert err.error and err.row_count == 0


def test_export_pack_sql(spark, demo):
    res = run_pack(demo, detect_roles(demo, "sql"), "demo", collect=False)
    text = pack_sql_text(res, "demo.csv", "demo", now=datetime.datetime(2024, 1, 2, 3, 4))
    assert text.startswith("-- Query pack over demo (from demo.csv), written 2024-01-02 03:04\n")
    assert "-- Size of the table: " in text and text.count(";\n") == len(res)
    d = tempfile.mkdtemp(prefix="tabulon-k3-")
    export_pack_sql(spark, res, os.path.join(d, "pack"), "demo.csv", "demo")
    files = [f for f in os.listdir(os.path.join(d, "pack")) if f.startswith("part-")]
    assert len(files) == 1


def test_limit_rows(demo):
    assert limit_rows(demo, 3, ["Revenue"]).collect()[0]["Product"] == "Wireless Mouse"
    assert limit_rows(demo, 100).count() == 16


def test_accuracy_score():
    assert ml.accuracy_score({"R2": 0.81234, "RMSE": 1.0}, 90) == 0.8123
    assert ml.accuracy_score({}, 90) == 90
    assert ml.accuracy_score({"R2": float("nan")}, 77) == 77


def test_problem_type(spark):
    df = spark.createDataFrame([(i % 3, float(i)) for i in range(30)], "k long, v double")
    assert ml.detect_problem_type(df, "k", {}) == "classification"
    assert ml.detect_problem_type(df, "v", {}) == "regression"
    assert ml.detect_problem_type(df, "v", {"v": "categorical"}) == "classification"


def test_split_is_stable(spark):
    df = spark.range(2000).select(F.col("id"), (F.col("id") * 3).alias("x"))
    a, b = ml.split(df)
    n_a = a.count()
    assert n_a + b.count() == 2000 and 1500 < n_a < 1700
    assert a.exceptAll(ml.split(df)[0]).count() == 0
