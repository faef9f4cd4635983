"""Ranks, running totals and overall figures of any number of groups against windows over all of them."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabulon.functions.roles import Roles, detect_roles
from tabulon.operators.ranking import rank_and_running
from tabulon.plans import querypack as qp


@pytest.mark.parametrize("kind", ["double", "bigint", "decimal(12,2)"])
def test_equals_the_global_windows(spark, kind):
    # Ties of all sizes (zero is half of the rows), nulls, negative values, and NaN where there is one.
    rows = [(i, None if i % 17 == 0 else 0 if i % 2 else (i * 37) % 90 - 40) for i in range(600)]
    df = spark.createDataFrame(rows, "g long, v long").select("g", F.col("v").cast(kind).alias("v")).repartition(7)
    if kind == "double":
        df = df.withColumn("v", F.when(F.col("g") > 597, F.lit(float("nan"))).otherwise(F.col("v")))
    w = Window.orderBy(F.desc("v"))
    want = df.select("g", F.rank().over(w).alias("r"), F.sum("v").over(w).alias("s"))
    got = rank_and_running(df, "v", rank="r", running="s", num_partitions=9).select("g", "r", "s")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.withColumn("r", F.col("r").cast("long")).collect()))


def test_nothing_but_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "g long, v double")
    assert sorted(map(tuple, rank_and_running(df, "v").collect())) == [(1, None, 1, None), (2, None, 1, None)]
    assert rank_and_running(df.where("g > 2"), "v").collect() == []


def test_named_category_gives_the_same_pack(demo):
    found, named = detect_roles(demo, "sql"), detect_roles(demo, "sql", category="Product")
    assert found.category_bounded and not named.category_bounded and not Roles(category="Product").category_bounded
    named_all, found_all = (qp.run_pack(demo, r, "demo") for r in (named, detect_roles(demo.drop("Category"), "sql")))
    for key in ("having_filter", "cte_ranked", "window_rank", "window_running"):
        assert named_all[key].error is None and named_all[key].rows == found_all[key].rows, key
