"""Frequent values of wide dictionaries get their codes without a shuffle; the others by two."""

import pytest
from pyspark.sql import functions as F

from tabulon.operators import ml


def _shuffles(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") + str(df._jdf.queryExecution().optimizedPlan()).count("RepartitionByExpression")


@pytest.mark.parametrize("rare", [0, 30])
def test_hot_and_rare_values(spark, monkeypatch, rare):
    monkeypatch.setattr(ml, "HOT_ROWS", 50)
    rows = [(i, None if i % 9 == 0 else f"h{i % 3}", f"r{i}" if i < rare else "hot") for i in range(600)]
    df = spark.createDataFrame(rows + rows[:5], "id long, a string, b string").repartition(4)
    enc, _ = ml.label_encode(df, ["a", "b"], dictionary_rows=0)
    rank = [{v: float(k) for k, v in enumerate(sorted({r[j] for r in rows} - {None}))} for j in (1, 2)]
    want = sorted((i, rank[0].get(a, -1.0), rank[1][b]) for i, a, b in rows + rows[:5])
    assert sorted((r.id, -1.0 if r.a is None else r.a, r.b) for r in enc.collect()) == want
    assert (_shuffles(enc) == 0) == (rare == 0)
