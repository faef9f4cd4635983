"""Upload intake as a stream: every file dropped in a folder is one micro-batch.

The reference handles one uploaded file per request, each run through a
whole flow.  Here a file-source stream (``maxFilesPerTrigger=1``) hands each
new file to ``foreachBatch``, which runs a flow on it and writes the results
under ``<out>/batch=<id>/``.  Writes overwrite by batch id, so a batch that
is replayed after a failure produces the same files (exactly-once output);
progress lives in a checkpoint folder under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tabulon.functions.roles import detect_roles
from tabulon.operators import stats as S
from tabulon.plans.workflows import bi_clean, sql_prepare
from tabulon.plans.querypack import build_pack
from tabulon.session import ensure_checkpoint_dir, scratch_path
from tabulon.sources.csv import NA_TOKENS


def _prepare(batch: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F
    return batch.select(*[F.when(F.col(f"`{c}`").isin(NA_TOKENS), None).otherwise(F.col(f"`{c}`")).alias(c)
                          if isinstance(batch.schema[c].dataType, T.StringType) else F.col(f"`{c}`")
                          for c in batch.columns])


def process_upload(batch: DataFrame, out_dir: str, batch_id: int) -> None:
    """One upload: BI cleaning, KPIs and the SQL pack results, written as parquet tables."""
    base = f"{out_dir.rstrip('/')}/batch={batch_id}"
    cleaned, _ = bi_clean(_prepare(batch))
    cleaned.write.mode("overwrite").parquet(f"{base}/cleaned")
    saved = batch.sparkSession.read.parquet(f"{base}/cleaned")
    roles = detect_roles(saved, "bi")
    S.kpis(saved, roles.revenue, roles.cost).write.mode("overwrite").parquet(f"{base}/kpis")
    prepared = sql_prepare(saved)
    sql_roles = detect_roles(prepared, "sql")
    failed = []
    for key, pq in build_pack(prepared, sql_roles).items():
        try:
            pq.build(prepared).write.mode("overwrite").parquet(f"{base}/pack/{key}")
        except Exception as exc:  # a query that cannot run on this upload leaves its error
            failed.append((key, str(exc).splitlines()[0]))
    if failed:
        batch.sparkSession.createDataFrame(failed, "query string, error string").write.mode("overwrite").parquet(f"{base}/failed")


def watch_uploads(spark: SparkSession, in_dir: str, out_dir: str, schema: T.StructType, sep: str = ",",
                  checkpoint: str | None = None, available_now: bool = True):
    """Start the intake stream; with ``available_now`` it processes what is there and stops."""
    ensure_checkpoint_dir(spark)
    ckpt = checkpoint or scratch_path(spark, "uploads-stream")
    stream = (spark.readStream.schema(schema).option("header", True).option("sep", sep)
              .option("maxFilesPerTrigger", 1).csv(in_dir))
    writer = (stream.writeStream.foreachBatch(lambda df, bid: process_upload(df, out_dir, bid))
              .option("checkpointLocation", ckpt))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
