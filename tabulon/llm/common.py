"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import os
import pathlib
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def fresh(name: str, taken: Iterable[str]) -> str:
    """`name`, with underscores added until no column has it (Spark compares without case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def input_bytes(df: DataFrame) -> int:
    """Spark's own estimate of the plan's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_for(df: DataFrame, per_part: int = 16 << 20) -> int:
    """Number of key ranges so that a range's share of the input stays near `per_part` bytes.

    Where Spark can't estimate the size (rows made in the driver), the number of shuffle partitions decides.
    """
    least = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 16)
    size = input_bytes(df)
    return least if size >= 1 << 60 else max(least, -(-size // per_part))


def deliver(spark: SparkSession) -> None:
    """Send this package to the executors, once a context, so that tasks import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_tabulon_delivered", False):
        return
    package = pathlib.Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="tabulon-code-")  # the driver serves the file as long as the context lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    to = os.path.join(folder, "tabulon.zip")
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent).as_posix())
    sc.addPyFile(to)
    sc._tabulon_delivered = True


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: T.StructType) -> DataFrame:
    deliver(df.sparkSession)
    return df.mapInArrow(run, schema)


def map_text(df: DataFrame, columns: list[str], fn: Callable[[pa.RecordBatch], Iterator[dict]],
             schema: T.StructType) -> DataFrame:
    """mapInArrow over some columns: `fn(batch)` yields dicts of arrays, one dict for each result batch."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for out in fn(batch):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return arrow_map(df.select(*columns), run, schema)


def append_columns(df: DataFrame, text: str, fields: list[T.StructField],
                   fn: Callable[[pa.Array], dict]) -> tuple[DataFrame, dict[str, str]]:
    """The rows with new columns computed from one text column; every input column is passed through.

    `fn` gets the text array of a batch and returns name -> values.  Returns the frame and the names the new
    columns got (underscores are added where the input has a column of that name).
    """
    names: dict[str, str] = {}
    for f in fields:
        names[f.name] = fresh(f.name, [*df.columns, *names.values()])
    schema = T.StructType([*df.schema.fields, *[T.StructField(names[f.name], f.dataType, True) for f in fields]])
    added = to_arrow_schema(T.StructType(fields))
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = fn(batch.column(at)) if batch.num_rows else {f.name: [] for f in added}
            arrays = [*batch.columns, *[pa.array(new[f.name], type=f.type) for f in added]]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return arrow_map(df, run, schema), names


def remove_tables(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete tables of this run under the shared folder that nothing will read again."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
