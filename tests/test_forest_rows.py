"""A forest keeps no counted rows, and the rows it reads many times are written compressed and in their order."""

import datetime as dt
import pathlib
import threading
import time

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tabulon.operators import ml
from tabulon.plans import fixtures as fx
from tabulon.session import FREED


@pytest.fixture(scope="module")
def points(spark):
    df = spark.range(0, 6000, 1, 3).select((F.rand(1) * 100).alias("a"), (F.col("id") % 17).cast("double").alias("b"), F.randn(3).alias("c"))
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="f").transform(df.withColumn("y", F.col("a") * F.col("b") + F.col("c")))


@pytest.mark.parametrize("more", [{}, {"subsamplingRate": 0.5, "maxDepth": 3}, {"bootstrap": False}, {"numTrees": 1}])
def test_trees_are_those_of_mllib(points, more):
    kw = {"featuresCol": "f", "labelCol": "y", "numTrees": 8, "seed": 42, **more}
    want, got = (kind(**kw).fit(points) for kind in (RandomForestRegressor, ml.RandomForestRegressor))
    assert got.toDebugString.split("\n", 1)[1] == want.toDebugString.split("\n", 1)[1]
    assert got.featureImportances == want.featureImportances and got.numFeatures == 3 and got.getNumTrees == want.getNumTrees
    assert got.transform(points).agg(F.sum("prediction")).first() == want.transform(points).agg(F.sum("prediction")).first()


def test_no_row_is_cached(spark, points):
    kept, before = [], spark.sparkContext._jsc.getPersistentRDDs().size()
    run = threading.Thread(target=lambda: ml.RandomForestRegressor(featuresCol="f", labelCol="y", numTrees=30, seed=1).fit(points))
    run.start()
    while run.is_alive():
        kept.append(spark.sparkContext._jsc.getPersistentRDDs().size())
        time.sleep(0.01)
    assert max(kept) <= before


def _files(spark) -> dict:
    top = pathlib.Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    return {p: p.stat().st_size for p in top.rglob("part-*") if p.is_file()}


def test_written_rows_are_small_and_stay(spark):
    df = spark.range(0, 90000, 1, 3).select(*[(F.col("id") % n).cast("double").alias(f"x{n}") for n in range(2, 12)])
    before = _files(spark)
    out = ml.written(df, 50000)
    new = {p: n for p, n in _files(spark).items() if p not in before}
    assert sum(new.values()) < 90000 * 10 * 8 / 10
    part = F.spark_partition_id().alias("part")
    assert out.select(part, "*").collect() == df.select(part, "*").collect() and out.schema == df.schema


def test_written_rows_dealt(spark):
    rows = [(i, None if i % 3 else f"v{i}", i / 7, dt.date(2020, 1, 1) + dt.timedelta(i), dt.datetime(2020, 1, 1, 5) + dt.timedelta(0, i), i % 2 == 0)
            for i in range(1000)]
    df = spark.createDataFrame(rows, "i long, s string, x double, d date, t timestamp, b boolean").coalesce(1)
    out = ml.written(df, 64)
    held = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("part")).count().collect()]
    assert len(held) == 16 and max(held) == 64 and out.schema == df.schema
    assert [tuple(r) for r in out.orderBy("i").collect()] == rows
    assert ml.written(df.limit(0), 64).count() == 0


def _shuffles(spark) -> set:
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}


def _left(spark, before: set) -> set:
    """New shuffle files; freeing them takes a moment."""
    until = time.time() + 10
    while (left := _shuffles(spark) - before) and time.time() < until:
        time.sleep(0.2)
    return left


def test_shuffles_of_written_rows_go(spark, monkeypatch):
    df = spark.range(0, 20000, 1, 2).select(F.col("id").cast("double").alias("x"))
    monkeypatch.setattr(ml, "_parts", lambda df, rows: 40)  # counting shuffles too
    before = _shuffles(spark)
    out = ml.written(df, 500)
    assert not _left(spark, before)
    assert out.rdd.getNumPartitions() == 40 and tuple(out.agg(F.sum("x"), F.count("x")).first()) == (20000 * 19999 / 2, 20000)


def test_shuffles_of_the_sales_join_go(spark, tmp_path, monkeypatch):
    for name, columns, rows in (
            ("region", "r_regionkey long, r_name string", [(0, "ASIA")]), ("nation", "n_nationkey long, n_regionkey long", [(0, 0)]),
            ("customer", "c_custkey long, c_nationkey long, c_mktsegment string", [(1, 0, "AUTO")]),
            ("orders", "o_orderkey long, o_custkey long", [(i, 1) for i in range(50)]),
            ("part", "p_partkey long, p_type string, p_retailprice double", [(i, f"T{i}", 2.0) for i in range(9)]),
            ("lineitem", "l_orderkey long, l_linenumber int, l_partkey long, l_shipdate timestamp, l_quantity double, l_extendedprice double",
             [(i % 50, i, i % 9, dt.datetime(2020, 1, 1), 3.0, float(i)) for i in range(400)])):
        spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / f"{name}.parquet"))
    monkeypatch.setattr(fx, "_WRITTEN", {})
    was, before = spark.conf.get(FREED, None), _shuffles(spark)
    out = fx.sales(spark, str(tmp_path))
    assert not _left(spark, before) and spark.conf.get(FREED, None) == was
    assert out.count() == 400 and {r["cost"] for r in out.select("cost").distinct().collect()} == {6.0}


def test_forecast_ordered_by_its_target(spark, monkeypatch):
    monkeypatch.setattr(ml, "FOREST_BYTES", 100 * 240)
    df = spark.range(0, 600, 1, 1).select((F.col("id") % 10).cast("double").alias("x"), ((F.col("id") % 10) * 5.0).alias("y"))
    got = ml.bi_forecast(df, "y", ["y"], num_trees=3)
    assert got["next_prediction"] == 45.0 and got["current_avg"] == 22.5
