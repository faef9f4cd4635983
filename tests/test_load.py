"""LOAD: what the flows write, and what a failed write leaves."""

import os

import pytest
from pyspark.sql import functions as F

from tabulon.plans import workflows as W
from tabulon.sources import sinks
from tabulon.sources.csv import read_csv


def test_failed_write_leaves_the_old_table(spark, tmp_path):
    path = sinks.save_table(spark.range(5), path=str(tmp_path / "t"))
    bad = spark.range(10).select(F.when(F.col("id") == 9, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    for write in (lambda: sinks.save_table(bad, path=path), lambda: sinks.write_csv(bad, path)):
        with pytest.raises(Exception, match="no"):
            write()
        assert spark.read.parquet(path).count() == 5 and os.listdir(tmp_path) == ["t"]
    grown = spark.read.parquet(path).union(spark.range(3))
    sinks.save_table(grown, path=path)      # reads what it replaces
    assert spark.read.parquet(path).count() == 8 and os.listdir(tmp_path) == ["t"]
    sinks.save_table(spark.range(2), path=path, mode="append")
    assert spark.read.parquet(path).count() == 10


def test_etl_loads(spark, demo, tmp_path):
    for _ in range(2):                      # the second run replaces the first one's
        out = W.etl(demo, order_by=["Month", "Product"], with_model=False, out_dir=str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == ["cleaned", "cleaned_csv"]
    want = sorted(map(str, out["cleaned"].collect()))
    assert sorted(map(str, spark.read.parquet(out["paths"]["cleaned"]).collect())) == want
    assert read_csv(spark, out["paths"]["cleaned_csv"]).count() == 16
    steps = [tuple(r) for r in out["logs"].frame(spark).where("phase = 'LOAD'").orderBy("seq").collect()]
    assert [(s[3].split(":")[0], s[4]) for s in steps] == [("csv", 16), ("parquet", 16)]


def test_reports_and_packs_are_written(spark, demo, tmp_path):
    bi = W.bi_report(demo, with_model=False, out_dir=str(tmp_path / "bi"))
    assert sorted(os.listdir(tmp_path / "bi")) == ["chart", "cleaned_data", "statistics", "summary"]
    assert read_csv(spark, bi["paths"]["cleaned_data"]).count() == bi["cleaned"].count()
    assert read_csv(spark, bi["paths"]["summary"]).where("kpi = 'Total Revenue'").first()["value"] == 7136000
    assert {r["phase"] for r in bi["steps"].frame(spark).collect()} >= {"EXTRACT", "CLEAN", "FEATURE", "LOAD"}
    sql = W.sql_pack(demo.withColumnRenamed("Units", "Units sold"), table="loaded", out_dir=str(tmp_path / "sql"))
    assert spark.read.parquet(sql["paths"]["loaded"]).count() == 16
    text = "\n".join(r["value"] for r in spark.read.text(sql["paths"]["pack"]).collect())
    assert text.count(";") >= len(sql["queries"]) and "SELECT COUNT(*) AS total_rows FROM `loaded`" in text
    steps = sql["steps"].frame(spark)
    assert steps.where("phase = 'QUERY'").count() == len(sql["queries"])
    assert steps.where("phase = 'PREPARE' AND `column` = 'Units_sold'").count() == 1
