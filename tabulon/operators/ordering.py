"""Order-dependent operators without one giant partition.

Spark rows have no implicit order, so every operator here takes an explicit
``order_by``; :func:`scan_order` gives rows the order of the files they come
from, as ids that need no sort.  A global window (``Window.orderBy`` without ``partitionBy``)
would move the whole table into one task; instead:

1. ``repartitionByRange`` on the order key (plus a tie-break so that a key
   holding a third of all rows is still split across tasks), written once
   with ``checkpoint()`` so rows cannot move between partitions afterwards;
2. a small per-partition summary (row count, or the last non-null value),
   at most one row per partition, gives every partition its carry-in;
3. a per-partition pass applies local position/fill plus the carry-in.
"""

from __future__ import annotations

import datetime as dt

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.numeric import ROW_ID, data_columns, q
from tabulon.operators.quantiles import stable_input
from tabulon.session import deliver, materialize

#: Where a row stands: its file, the split of the file, and an ascending number within the split.
FILE, START, POS = "__file", "__start", "__pos"
_TB = "__tb"
_ROW = "__row"
_PID = "__pid"
TARGET_PARTITION_BYTES = 256 * 1024 * 1024
MAX_PARTITIONS = 200_000
#: A table of so many splits (some 200 bytes each) is sent to every task; beyond it Spark chooses the join.
BROADCAST_SPLITS = 200_000
#: Spark gives rows made in the driver the largest size there is; they are small.
UNKNOWN_SIZE = 1 << 60


def partitions_for(df: DataFrame) -> int:
    """Partition count for a range partitioning of ``df``: its input bytes (the sum of the
    scanned relations' sizes, an upper bound) over 256 MB, at least the session's shuffle
    partitions.  A global order has to be cut into tasks that fit executor memory."""
    base = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        total = 0
        for i in range(leaves.size()):
            size = leaves.apply(i).stats().sizeInBytes()
            size = size if isinstance(size, int) else int(size.toString())
            total += size if size < UNKNOWN_SIZE else 0
    except Exception:  # no JVM handle: keep the session setting
        return base
    return max(base, min(MAX_PARTITIONS, -(-total // TARGET_PARTITION_BYTES)))


def scan_place(df: DataFrame) -> DataFrame:
    """The rows of a file scan with their file, split and number in it.

    ``monotonically_increasing_id`` ascends within a partition, and a split is read by one partition from its beginning
    to its end, whatever other splits Spark packs into that partition.
    """
    return df.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(START),
                     F.monotonically_increasing_id().alias(POS))


def number_rows(placed: DataFrame, name: str = ROW_ID) -> DataFrame:
    """0, 1, ... by (file, split, number in the split), without a sort.

    The rows are written once, so places cannot change between the two passes.  One aggregate counts the rows of each
    split; the sum of the counts before a split (a table of a row for each split, in file order) is its offset.  Within a split the
    numbers ascend without gaps, except where records were put together from lines; those splits rank their rows.
    """
    pinned = materialize(placed)
    splits = pinned.groupBy(FILE, START).agg(F.count(F.lit(1)).alias("n"), F.min(POS).alias("lo"), F.max(POS).alias("hi")).collect()
    offsets, total = [], 0
    for r in sorted(splits, key=lambda r: (r[FILE], r[START])):
        offsets.append((r[FILE], r[START], total, r["lo"], r["hi"] - r["lo"] + 1 != r["n"]))
        total += r["n"]
    table = placed.sparkSession.createDataFrame(offsets, f"{FILE} string, {START} bigint, __off bigint, __lo bigint, __gaps boolean")
    rows = pinned.join(F.broadcast(table) if len(offsets) <= BROADCAST_SPLITS else table, [FILE, START])
    kept = [q(c) for c in placed.columns if c not in (FILE, START, POS)]
    out = rows.where("NOT __gaps").select(*kept, (F.col("__off") + F.col(POS) - F.col("__lo")).alias(name))
    if any(o[4] for o in offsets):
        within = F.row_number().over(Window.partitionBy(FILE, START).orderBy(POS)) - 1
        out = out.union(rows.where("__gaps").select(*kept, (F.col("__off") + within).alias(name)))
    return out


def scan_order(df: DataFrame, name: str = ROW_ID) -> DataFrame:
    """The rows with ids in scan order: file order where the rows come straight from files, else the order in which
    Spark holds them (partition by partition)."""
    try:
        placed = scan_place(df)
    except PySparkException:                   # not a plain scan of files
        placed = df.select("*", F.lit("").alias(FILE), F.spark_partition_id().cast("long").alias(START),
                           F.monotonically_increasing_id().alias(POS))
    return number_rows(placed, name)


def _order_cols(order_by) -> list[Column]:
    if isinstance(order_by, (str, Column)):
        order_by = [order_by]
    return [q(c) if isinstance(c, str) else c for c in order_by]


def range_partitioned(df: DataFrame, order_by, num_partitions: int | None = None) -> DataFrame:
    """Range-partition on ``order_by`` + a tie-break, sort inside, pin with a checkpoint.

    The tie-break is a hash of the whole row, so rows with equal keys spread
    over several partitions in a stable order; a row id splits equal rows,
    whose relative order cannot matter.  The id must not change when a task
    runs again, so an input that comes out of a shuffle is written first.
    """
    n = num_partitions or partitions_for(df)
    keys = _order_cols(order_by)
    tb = F.xxhash64(*[q(c) for c in df.columns]).alias(_TB)
    ranged = (stable_input(df, df.columns).select("*", tb, F.monotonically_increasing_id().alias(_ROW))
                .repartitionByRange(n, *keys, F.col(_TB), F.col(_ROW))
                .drop(_ROW)
                .sortWithinPartitions(*keys, F.col(_TB))
                .withColumn(_PID, F.spark_partition_id()))
    return materialize(ranged)


def row_index(df: DataFrame, order_by, name: str = "row_index", num_partitions: int | None = None) -> DataFrame:
    """0-based position in ``order_by`` order.

    After range partitioning, ``monotonically_increasing_id`` is
    ``(partition << 33) + position within the partition``; the offset of each
    partition is the sum of the sizes of the partitions before it (one row per
    partition, a table bounded by the partition count).
    """
    r = range_partitioned(df, order_by, num_partitions)
    keys = _order_cols(order_by)
    sizes = sorted((row[_PID], row["n"]) for row in r.groupBy(_PID).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, acc = [], 0
    for pid, n in sizes:
        offsets.append((pid, acc))
        acc += n
    # One row per partition: a broadcast side whose size is bounded by the partition count.
    off = df.sparkSession.createDataFrame(offsets, f"{_PID} int, __off bigint")
    local = (r.sortWithinPartitions(*keys, F.col(_TB))
              .select("*", (F.monotonically_increasing_id() - F.shiftleft(F.col(_PID).cast("long"), 33)).alias("__loc")))
    out = local.join(F.broadcast(off), _PID).select(*[q(c) for c in df.columns],
                                                    (F.col("__off") + F.col("__loc")).alias(name))
    return out


def _scalar(value, kind: pa.DataType) -> pa.Scalar:
    """A collected value as an Arrow scalar; Spark hands timestamps out as naive local times."""
    if pa.types.is_timestamp(kind) and kind.tz is not None and value.tzinfo is None:
        value = value.astimezone(dt.timezone.utc)
    return pa.scalar(value, type=kind)


def forward_fill(df: DataFrame, cols: list[str], order_by, num_partitions: int | None = None) -> DataFrame:
    """Replace nulls by the last earlier non-null value in ``order_by`` order; leading nulls stay.

    Per partition: local fill of the named columns in Arrow (no shuffle, other
    columns pass through untouched), seeded with the carry-in: the last non-null of the nearest earlier
    partition that has one (a table of at most one row per partition).
    """
    if not cols:
        return df
    r = range_partitioned(df, order_by, num_partitions)
    keys = _order_cols(order_by)
    order_struct = F.struct(*keys, F.col(_TB))
    last_rows = r.groupBy(_PID).agg(*[
        F.max_by(q(c), F.when(q(c).isNotNull(), order_struct)).alias(f"l{i}") for i, c in enumerate(cols)]).collect()
    last = {row[_PID]: [row[f"l{i}"] for i in range(len(cols))] for row in last_rows}
    carry: dict[int, list] = {}
    running = [None] * len(cols)
    for pid in sorted(last):
        carry[pid] = list(running)
        running = [v if v is not None else running[i] for i, v in enumerate(last[pid])]
    schema = r.schema
    # One entry per partition, shipped once per executor rather than in every task closure.
    carry_b = df.sparkSession.sparkContext.broadcast(carry)

    at = [r.columns.index(c) for c in cols]
    pid_at = r.columns.index(_PID)

    def fill(batches):
        state: dict[int, list] = {}
        for batch in batches:
            if batch.num_rows:
                pid = batch.column(pid_at)[0].as_py()
                if pid not in state:
                    state[pid] = [None if v is None else _scalar(v, batch.column(i).type)
                                  for v, i in zip(carry_b.value.get(pid, [None] * len(cols)), at)]
                arrays = list(batch.columns)
                for j, i in enumerate(at):
                    filled = pc.fill_null_forward(arrays[i])
                    if state[pid][j] is not None:
                        filled = pc.fill_null(filled, state[pid][j])
                    arrays[i] = filled
                    if filled[-1].is_valid:
                        state[pid][j] = filled[-1]
                batch = pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)
            yield batch

    deliver(df.sparkSession)
    filled = r.sortWithinPartitions(*keys, F.col(_TB)).mapInArrow(fill, schema)
    return filled.drop(_TB, _PID)


def preview(df: DataFrame, order_by, n: int = 100) -> DataFrame:
    """First ``n`` rows in ``order_by`` order (top-K, no global sort)."""
    return df.orderBy(*_order_cols(order_by)).limit(n)


def page(df: DataFrame, order_by, page_no: int, page_size: int = 12) -> DataFrame:
    """Rows ``page_no*page_size`` .. +``page_size`` in order."""
    return df.orderBy(*_order_cols(order_by)).offset(page_no * page_size).limit(page_size)


def search(df: DataFrame, term: str) -> DataFrame:
    """Rows whose concatenated text contains ``term``, case-insensitive."""
    text = F.lower(F.concat_ws("", *[q(c).cast("string") for c in data_columns(df)]))
    return df.where(F.contains(text, F.lit(term.strip().lower())))
