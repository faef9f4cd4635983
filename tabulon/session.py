"""Spark session helpers.

Every operator in the package takes and returns DataFrames and never
creates a session on its own; this module is only used by tests, the
bench and the driver entry points.
"""

from __future__ import annotations

import atexit
import os
import pathlib
import shutil
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale: AQE re-plans joins and coalesces or splits
# shuffle partitions at runtime, so small local runs and 100 TB runs share
# one code path.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # what a flow has written with checkpoint() goes when its frames are gone
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tabulon") -> SparkSession:
    """Build (or reuse) a session with the defaults the package relies on."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("TABULON_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def session_key(spark: SparkSession) -> int:
    """A stable identity of the session, for per-session handle caches."""
    j = getattr(spark, "_jsparkSession", None)
    return j.hashCode() if j is not None else id(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the operator of the cluster sets it to shared storage and we
    only read it.  Only when it is unset (local tests) do we pick a folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = None
    try:
        sc = spark.sparkContext
        path = path or sc.getConf().get("spark.checkpoint.dir", None)
    except Exception:  # sessions without a local SparkContext
        sc = None
    if not path:
        if sc is None or not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tabulon-ckpt-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared checkpoint dir.

    Used where a plan is re-read several times (sequential outlier filters,
    partition-indexed fills): the checkpoint survives executor loss, unlike a
    local checkpoint or a cache.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


#: Spark's setting for it, of version 4; others don't know it and free such files when the driver collects its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Around a query whose result is written and read from there: its shuffle files go as soon as it has run."""
    was = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if was is None else spark.conf.set(FREED, was)


def deliver(spark: SparkSession) -> None:
    """Send this package to the executors, once a context, so that tasks import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_tabulon_delivered", False):
        return
    package = pathlib.Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tabulon-code-")  # the driver serves the file as long as the context lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    to = os.path.join(folder, "tabulon.zip")
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent).as_posix())
    sc.addPyFile(to)
    sc._tabulon_delivered = True
