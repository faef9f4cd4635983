import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import ml
from tabulon.operators.linear import fit_ridge
from tabulon.plans import workflows as W


@pytest.fixture(scope="module")
def linear(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(300):
        x1, x2 = rnd.uniform(0, 10), rnd.uniform(-5, 5)
        rows.append((x1, x2, rnd.choice(["north", "south"]), 3 * x1 - 2 * x2 + 5 + rnd.gauss(0, 0.5)))
    return spark.createDataFrame(rows, "x1 double, x2 double, region string, sales double")


def test_ridge_equals_closed_form(spark, linear):
    feats = ["x1", "x2", "same"]
    data = linear.select("x1", "x2", F.lit(0.1).alias("same"), F.col("sales").alias(ml.LABEL))
    gaps = data.union(spark.createDataFrame([(None, 1.0, 0.1, 3.0), (1.0, 2.0, 0.1, None), (float("nan"), 0.0, 0.1, 1.0)], data.schema))
    model = fit_ridge(gaps.repartition(5), feats, ml.LABEL, alpha=2.0)
    pdf = data.toPandas()
    X = pdf[feats].to_numpy()
    Xs = (X - X.mean(0)) / np.where(np.arange(3) < 2, X.std(0), 1.0)
    y = pdf[ml.LABEL].to_numpy()
    w = np.linalg.solve(Xs.T @ Xs + 2 * np.eye(3), Xs.T @ (y - y.mean()))
    assert np.allclose(model.coefficients, w, rtol=1e-9, atol=1e-9)
    assert math.isclose(model.intercept, y.mean(), rel_tol=1e-12)
    got = model.transform(data).select("prediction").toPandas()["prediction"].to_numpy()
    assert np.allclose(np.sort(got), np.sort(Xs @ w + y.mean()))
    with pytest.raises(ValueError):
        fit_ridge(data.limit(0), feats, ml.LABEL)


def test_auto_ml_regression(linear):
    r = ml.auto_ml(linear, "sales", num_trees=20)
    assert r.problem_type == "regression"
    assert r.best_metrics["R2"] > 0.9
    assert {x["model"] for x in r.scores.collect()} == {"Ridge Regression", "Random Forest"}
    assert r.predictions.count() <= 100
    assert "region" in r.features


def test_auto_ml_classification(spark, linear):
    df = linear.withColumn("label", F.when(F.col("sales") > 20, "hi").otherwise("lo"))
    r = ml.auto_ml(df.drop("sales"), "label", num_trees=10)
    assert r.problem_type == "classification" and r.best_model == "Random Forest"
    assert r.best_metrics["Accuracy"] > 0.7
    assert {x["actual"] for x in r.predictions.collect()} <= {"hi", "lo"}


def test_label_encode_sorted(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "s string")
    enc, tabs = ml.label_encode(df, ["s"])
    assert sorted((r["value"], r["code"]) for r in tabs["s"].collect()) == [("a", 0), ("b", 1), ("c", 2)]
    assert sorted(r["s"] for r in enc.collect()) == [0.0, 0.0, 1.0, 2.0]


@pytest.mark.parametrize("limit", [0, 3, 1000])
def test_label_codes_of_several_columns(spark, limit):
    rows = [(i, None if i % 7 == 0 else f"v{i % 5}", "hot" if i % 3 else f"u{i}", i % 2 == 0, None) for i in range(200)]
    df = spark.createDataFrame(rows + rows[:3], "id long, a string, b string, c boolean, d string").repartition(6)
    enc, tabs = ml.label_encode(df, ["a", "b", "c", "d"], dictionary_rows=limit)
    assert enc.columns == df.columns and dict(enc.dtypes) == {"id": "bigint", "a": "double", "b": "double", "c": "double", "d": "double"}
    text = [tuple(None if v is None else str(v).lower() for v in r[1:]) for r in rows]
    rank = [{v: float(k) for k, v in enumerate(sorted({t[j] for t in text} - {None}))} for j in range(4)]
    want = sorted((i, *[rank[j].get(t[j], -1.0) for j in range(4)]) for (i, *_), t in zip(rows + rows[:3], text + text[:3]))
    assert sorted((r[0], *[-1.0 if v is None else v for v in r[1:]]) for r in enc.collect()) == want
    assert {r["value"]: r["code"] for r in tabs["a"].collect()} == {k: int(v) for k, v in rank[0].items()} and tabs["d"].count() == 0


def test_workflows_on_demo(demo):
    a = W.analyst(demo, with_model=False)
    assert a["changes"]["quality_score"] == 100 and a["changes"]["duplicates_removed"] == 0
    bi = W.bi_report(demo, order_by=["Month", "Product"], with_model=False)
    kpi = {r["kpi"]: r["value"] for r in bi["summary"].collect()}
    assert kpi["Total Revenue"] == 7136000 and kpi["Net Profit"] == 7136000 - 4560000
    assert bi["roles"]["category"] == "Product"
    assert "Profit_Margin_%" in bi["cleaned"].columns
    sp = W.sql_pack(demo, table="demo_pack", collect=True)
    assert sp["roles"]["revenue"] == "Revenue" and "Profit_Margin_Pct" in sp["table"].columns
    assert all(r.error is None for r in sp["queries"].values())
    e = W.etl(demo, order_by=["Month", "Product"], with_model=False)
    assert e["cleaned"].count() == 16 and "Profit" in e["cleaned"].columns
    assert e["col_types"]["Category"] == "categorical"
