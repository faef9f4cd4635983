"""Column profiling and schema inference.

All per-column statistics are fused into one aggregate for counts, parse
checks and distinct-value sketches of every column, and one job for the exact
distinct counts that are asked for (see `distinct.py`).  The results are one
row per column, built on the driver from those small aggregate rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.numeric import DATE_TYPES, NUMERIC_TYPES, ROW_ID, data_columns, fails_number, fails_timestamp, q
from tabulon.operators import distinct as D

PROFILE_SCHEMA = T.StructType([
    T.StructField("column", T.StringType()),
    T.StructField("physical_type", T.StringType()),
    T.StructField("semantic_type", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("n_missing", T.LongType()),
    T.StructField("n_distinct", T.LongType()),
    T.StructField("missing_pct", T.DoubleType()),
])


@dataclass
class ColumnProfile:
    column: str
    physical_type: str
    semantic_type: str
    n: int              # non-null values
    n_missing: int
    n_distinct: int     # nulls excluded; an estimate where the caller asked for types only
    missing_pct: float  # of all rows, 2 dp
    rows: int


def _semantic(dtype: T.DataType, n: int, n_distinct: int, bad_ts: int, bad_num: int) -> str:
    """P1 rule.  Physical numerics never count as datetime (see README: quirks)."""
    if n == 0:
        return "empty"
    if isinstance(dtype, DATE_TYPES):
        return "datetime"
    if isinstance(dtype, T.StringType) and bad_ts == 0:
        return "datetime"
    if isinstance(dtype, (*NUMERIC_TYPES, T.BooleanType)) or (isinstance(dtype, T.StringType) and bad_num == 0):
        if n_distinct == 2:
            return "binary"
        return "categorical_num" if n_distinct <= 15 else "numeric"
    return "categorical" if n_distinct / n < 0.5 else "text"


def _limits(dtype: T.DataType, n: int) -> list[float]:
    """The distinct counts at which the P1 rule of a type turns."""
    if isinstance(dtype, DATE_TYPES):
        return []
    return [2.5, 15.5] if isinstance(dtype, (*NUMERIC_TYPES, T.BooleanType)) else [2.5, 15.5, n / 2]


def profile_columns(df: DataFrame, exact: bool = True) -> list[ColumnProfile]:
    """One row of statistics per column.

    One aggregate holds the counts, the parse checks and a distinct-value sketch of every column.  ``exact``: the
    distinct counts of all columns follow from a second job over (column, value) keys.  Otherwise only columns whose
    sketch lies near a limit of the type rule are counted; the others keep their estimate, and types are as exact.
    """
    from tabulon.operators.quantiles import stable_input
    fields = [f for f in df.schema.fields if f.name != ROW_ID]
    df = stable_input(df, [f.name for f in fields])
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(fields):
        c = q(f.name)
        aggs.append(F.count(c).alias(f"n{i}"))
        if not exact:
            aggs.append(D.sketch(f.name).alias(f"d{i}"))
        if isinstance(f.dataType, T.StringType):
            aggs.append(F.count_if(fails_timestamp(c)).alias(f"t{i}"))
            aggs.append(F.count_if(fails_number(c)).alias(f"x{i}"))
    base = df.agg(*aggs).first()
    if exact:
        distinct = D.counted(df, [f.name for f in fields])
    else:
        limits = {f.name: [1.5, *_limits(f.dataType, base[f"n{i}"])] for i, f in enumerate(fields)}
        distinct = {c: d.n for c, d in D.decided(df, {f.name: base[f"d{i}"] for i, f in enumerate(fields)}, limits).items()}
    rows = base["_rows"]
    out = []
    for i, f in enumerate(fields):
        n, miss, n_distinct = base[f"n{i}"], rows - base[f"n{i}"], distinct[f.name]
        bad_ts = base[f"t{i}"] if f"t{i}" in base else 1
        bad_num = base[f"x{i}"] if f"x{i}" in base else 1
        out.append(ColumnProfile(f.name, f.dataType.simpleString(), _semantic(f.dataType, n, n_distinct, bad_ts, bad_num),
                                 n, miss, n_distinct, round(miss / rows * 100, 2) if rows else 0.0, rows))
    return out


def profile_frame(spark: SparkSession, profiles: list[ColumnProfile]) -> DataFrame:
    return spark.createDataFrame(
        [(p.column, p.physical_type, p.semantic_type, p.n, p.n_missing, p.n_distinct, p.missing_pct) for p in profiles],
        PROFILE_SCHEMA)


def column_profile(df: DataFrame) -> DataFrame:
    """P1/P3/P5 as a table: one row per column."""
    return profile_frame(df.sparkSession, profile_columns(df))


def semantic_types(df: DataFrame) -> dict[str, str]:
    return {p.column: p.semantic_type for p in profile_columns(df, exact=False)}


def types_by_group(profile: DataFrame) -> DataFrame:
    """Columns grouped by semantic type."""
    return (profile.groupBy("semantic_type")
                   .agg(F.array_sort(F.collect_list("column")).alias("columns")))


def missing_report(df: DataFrame) -> DataFrame:
    """Missing count and percentage per column, one aggregate, unpivoted."""
    cols = data_columns(df)
    row = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(q(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c.replace(chr(39), chr(39) * 2)}', m{i}" for i, c in enumerate(cols))
    return row.selectExpr(f"stack({len(cols)}, {stack}) AS (column, n_missing)", "_rows").select(
        "column", "n_missing",
        F.round(F.try_divide(F.col("n_missing"), F.col("_rows")) * 100, 2).alias("missing_pct"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and duplicate rows (nulls equal), one shuffle.

    The group-by on all columns is partially aggregated per task first, so a
    row repeated a billion times is collapsed before the shuffle.
    """
    g = df.groupBy(*[q(c) for c in data_columns(df)]).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct_rows"),
                 (F.sum("_n") - F.count(F.lit(1))).alias("n_duplicates"))


def quality_score(rows_before: int, duplicates_removed: int, missing_cells: int, rows_after: int,
                  cols_after: int) -> int:
    """100 minus capped missing-cell and duplicate penalties, truncated to int, floor 0."""
    score = 100.0
    cells = rows_after * cols_after
    if missing_cells > 0 and cells:
        score -= min(30.0, missing_cells / cells * 100)
    if duplicates_removed > 0 and rows_before:
        score -= min(10.0, duplicates_removed / rows_before * 50)
    return max(0, int(score))


STEP_SCHEMA = T.StructType([
    T.StructField("seq", T.IntegerType()),
    T.StructField("phase", T.StringType()),
    T.StructField("column", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("n", T.LongType()),
])


class StepLog:
    """Phase-tagged change log, built from the statistics the operators already computed."""

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, phase: str, action: str, column: str | None = None, n: int | None = None) -> None:
        self.rows.append((len(self.rows) + 1, phase, column, action, None if n is None else int(n)))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, STEP_SCHEMA)
