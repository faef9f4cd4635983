"""Inputs that once lost rows or changed values."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import clean, stats
from tabulon.operators.ordering import forward_fill, range_partitioned, row_index
from tabulon.operators.quantiles import quantiles, quantiles_and_counts
from tabulon.plans import adhoc, querypack, workflows
from tabulon.sources import csv, sinks


def _write(tmp_path, data, name="in.csv"):
    path = tmp_path / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_standard_quoting(spark, tmp_path):
    text = 'id,t,n\n1,"say ""hi"", ok",2\n2,"line one\nline two",3\n3,"C:\\",4\n'
    got = csv.read_csv(spark, _write(tmp_path, text), multi_line=True).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 'say "hi", ok', 2), (2, "line one\nline two", 3), (3, "C:\\", 4)]
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(1, 'a "b", c'), (2, "C:\\"), (3, "x\ny")], "id long, t string")
    sinks.write_csv(df, out)
    back = csv.read_csv(spark, out, multi_line=True)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_wide_header_keeps_rows(spark, tmp_path):
    names = [f"a_rather_long_column_{i}" for i in range(500)]
    text = ",".join(names) + "\n" + "\n".join(",".join(str(i * j) for i in range(500)) for j in range(10)) + "\n"
    got = csv.read_csv(spark, _write(tmp_path, text), infer=False)
    assert got.columns == names and got.count() == 10


def test_header_is_decoded(spark, tmp_path):
    got = csv.read_csv(spark, _write(tmp_path, "país,x\nperú,1\n".encode("latin-1")))
    assert got.columns == ["país", "x"] and got.first()["país"] == "perú"


def test_codes_stay_text(spark, tmp_path):
    got = csv.read_csv(spark, _write(tmp_path, "code,v\n12F,1.5\n7D,2\n3f,1e3\n"))
    assert [r["code"] for r in got.collect()] == ["12F", "7D", "3f"] and dict(got.dtypes)["v"] == "double"


def test_gate_reads_plans(spark, tmp_path):
    target = tmp_path / "leak"
    assert not adhoc.is_query(f"WITH a AS (SELECT 1 AS x) INSERT OVERWRITE DIRECTORY '{target}' USING parquet SELECT * FROM a")
    assert adhoc.is_query("SELECT 'a;b'") and not adhoc.is_query("") and not adhoc.is_query("SHOW TABLES")
    r = adhoc.run_custom_query(spark, "SELECT id FROM range(500)")
    assert len(r.rows) == 200 and r.row_count == 500 and r.frame.count() == 500


def test_forward_fill_touches_only_its_columns(spark):
    big = 9007199254740993
    rows = [(1, None, big, None), (2, 1.5, None, dt.datetime(1600, 1, 1, 12)), (3, None, big + 2, None), (4, 2.5, big + 3, None)]
    df = spark.createDataFrame(rows, "k int, v double, big long, t timestamp")
    got = forward_fill(df, ["v", "t"], ["k"], 3).orderBy("k").collect()
    assert [r.big for r in got] == [big, None, big + 2, big + 3]
    assert [r.v for r in got] == [None, 1.5, 1.5, 2.5]
    assert [r.t for r in got] == [None, *[rows[1][3]] * 3]


def test_no_column_cuts(spark):
    df = spark.range(30).selectExpr(*[f"id * {i + 1} AS c{i}" for i in range(14)])
    assert stats.histogram(df).select("column").distinct().count() == 14
    assert stats.corr_matrix(df).select("col_a").distinct().count() == 14
    assert len(querypack.null_check(df).columns) == len(querypack.distinct_counts(df).columns) == 14


@pytest.mark.parametrize("values, total", [([4e-11] * 1000, 4e-8), ([1e30, 1.0], 1e30), ([float("inf"), 1.0], float("inf"))])
def test_summary_of_extreme_values(spark, values, total):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert stats.column_summary(df, digits=None).first()["sum"] == pytest.approx(total)


@pytest.mark.parametrize("share", [0.987, 0.7498])
def test_quantiles_beside_a_hot_value(spark, share):
    n = 3_000_000
    zeros = int(n * share)
    df = spark.range(n).select(F.when(F.col("id") < zeros, 0.0).otherwise(F.col("id") * 0.37 % 1000 - 3).alias("x"),
                               (F.col("id") % 3).alias("few"), F.lit(7).alias("one"))
    ids = np.arange(n)
    x = np.where(ids < zeros, 0.0, ids * 0.37 % 1000 - 3)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = quantiles(df, ["x", "few", "one"], probs)
    assert got["x"] == pytest.approx(np.quantile(x, probs).tolist())
    assert got["few"] == pytest.approx(np.quantile(ids % 3, probs).tolist()) and got["one"] == [7.0] * 7


def test_quantiles_of_missing_and_infinite_values(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(float(i), nan if i % 10 == 0 else float(i), inf if i > 97 else float(i), None)
                                for i in range(100)] + [(nan, None, -inf, None)], "a double, b double, c double, d double")
    got, counts, rows = quantiles_and_counts(df, ["a", "b", "c", "d"], [0.5, 0.99])
    kept = [i for i in range(100) if i % 10]
    assert got["a"] == pytest.approx([49.5, np.quantile(range(100), 0.99)])
    assert got["b"] == pytest.approx(np.quantile(kept, [0.5, 0.99]).tolist())
    assert got["c"] == [49.0, inf] and got["d"] == [None, None]
    assert counts == {"a": 100, "b": 90, "c": 101, "d": 0} and rows == 101
    filled, medians = clean.fill_median(spark.createDataFrame([(1.0,), (nan,), (None,), (2.0,), (nan,)], "v double"), ["v"])
    assert medians == {"v": 1.5}


def test_equal_rows_are_split(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("k"))
    sizes = [r["count"] for r in range_partitioned(df, ["k"], 7).groupBy("__pid").count().collect()]
    assert max(sizes) < 6000 and sum(sizes) == 30_000
    indexed = row_index(df, ["k"], "at", 7)
    assert indexed.select("at").distinct().count() == 30_000 and indexed.agg(F.max("at")).first()[0] == 29_999


def test_flows_take_nan(spark):
    nan = float("nan")
    df = spark.createDataFrame([("c%d" % (i % 3), float(i), nan if i % 4 == 0 else float(i * 2), float(i * i)) for i in range(40)],
                               "category string, revenue double, cost double, extra double")
    out = workflows.bi_report(df, order_by=["revenue"])
    assert "ml" in out and out["cleaned"].where("isnan(cost) or cost is null").count() == 0
    assert workflows.analyst(df, with_model=False)["changes"]["missing_values"]
