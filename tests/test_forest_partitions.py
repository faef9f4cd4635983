"""The rows of a forest come in partitions of bounded size, as a table with few large splits does not have them."""

import pytest
from pyspark.sql import functions as F

from tabulon.operators import ml


class Seen(Exception):
    pass


@pytest.mark.parametrize("run", [
    lambda df: ml.bi_forecast(df, "y", ["id"], num_trees=3),
    lambda df: ml.auto_ml(df, "y", num_trees=3),
    lambda df: ml.analyst_metrics(df, num_trees=3)])
def test_partitions_of_a_forest(spark, monkeypatch, run):
    held = []

    class Forest(ml.RandomForestRegressor):
        def fit(self, data):
            held.extend(r["count"] for r in data.groupBy(F.spark_partition_id().alias("p")).count().collect())
            return super().fit(data)

    monkeypatch.setattr(ml, "RandomForestRegressor", Forest)
    monkeypatch.setattr(ml, "FOREST_BYTES", 100 * 240)  # about a hundred rows
    run(spark.range(0, 2000, 1, 1).select("id", (F.col("id") % 17).alias("x"), (F.col("id") % 40 * 2.5).alias("y")))
    assert sum(held) > 1400 and max(held) < 200


def test_spread_keeps_small_tables(spark):
    df = spark.range(0, 1000, 1, 2)
    assert ml.spread(df, 500) is df
    got = ml.spread(df, 100)
    assert got.rdd.getNumPartitions() == 10 and sorted(r.id for r in got.collect()) == list(range(1000))
