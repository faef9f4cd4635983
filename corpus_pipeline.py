"""The corpus pipeline: each stage takes the documents its predecessor kept and decides about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabulon.llm import decontaminate, jaccard_join, language_id, mixing, secret_scan
from tabulon.llm.common import table
from tabulon.session import ensure_checkpoint_dir, scratch_path

STAGES = [
    ("language_id", language_id.stage),
    ("jaccard_join", jaccard_join.stage),
    ("decontaminate", decontaminate.stage),
    ("secret_scan", secret_scan.stage),
    ("mix_sources", mixing.stage),
]

#: Language ID and the search for near copies can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written in the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
