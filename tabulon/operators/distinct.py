"""Distinct values of many columns at once: sketches first, exact counts only where a decision hangs on them.

``count_distinct`` over many columns makes Spark expand every row once for each column and keep all values of all
columns apart.  Here exact counts unpivot the columns to (column, value) keys and group twice: equal values of a task
collapse before the shuffle, so a column with few values costs a few rows a task, however many columns there are.
Most questions only ask on which side of a limit a count lies; a mergeable sketch answers them for every column that is
far from the limit, and only the columns near it are counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.numeric import q

#: Relative standard error of the sketch, and how many of them a count may be off before it is counted exactly.
RSD, SIGMAS, LEAST = 0.02, 8, 8


@dataclass
class Distinct:
    n: int
    exact: bool


def key(df: DataFrame, name: str) -> Column:
    """A text that is equal for equal values (0.0 and -0.0 are, as is every NaN)."""
    kind, v = df.schema[name].dataType, q(name)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (v + F.lit(0.0).cast(kind)).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.hex(v)
    return v if isinstance(kind, T.StringType) else F.to_json(v) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else v.cast("string")


def exact_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(i, n): the number of distinct non-null values of the i-th column; columns without any have no row."""
    arms = [F.struct(F.lit(i).alias("i"), key(df, c).alias("v")) for i, c in enumerate(cols)]
    return df.select(F.inline(F.array(*arms))).where(F.col("v").isNotNull()).distinct().groupBy("i").agg(F.count(F.lit(1)).alias("n"))


def counted(df: DataFrame, cols: list[str]) -> dict[str, int]:
    """The exact counts by column, from one job."""
    found = {r["i"]: r["n"] for r in exact_counts(df, cols).collect()} if cols else {}
    return {c: found.get(i, 0) for i, c in enumerate(cols)}


def sketch(name: str) -> Column:
    return F.approx_count_distinct(q(name), RSD)


def near(estimate: int, limit: float) -> bool:
    """Whether the true count may lie on the other side of the limit."""
    return abs(estimate - limit) <= max(LEAST, SIGMAS * RSD * max(estimate, limit))


def decided(df: DataFrame, estimates: dict[str, int], limits: dict[str, list[float]]) -> dict[str, Distinct]:
    """Estimates where all limits of a column are far, exact counts (one job for all) of the others."""
    exact = counted(df, [c for c, e in estimates.items() if any(near(e, m) for m in limits[c])])
    return {c: Distinct(exact.get(c, e), c in exact) for c, e in estimates.items()}


def few_values(df: DataFrame, cols: list[str], limit: int) -> dict[str, bool]:
    """Of each column, whether it has at most `limit` distinct non-null values."""
    if not cols:
        return {}
    row = df.agg(*[sketch(c).alias(f"e{i}") for i, c in enumerate(cols)]).first()
    got = decided(df, {c: row[f"e{i}"] for i, c in enumerate(cols)}, {c: [limit + 0.5] for c in cols})
    return {c: d.n <= limit for c, d in got.items()}


def constant_columns(df: DataFrame, cols: list[str]) -> list[str]:
    """Columns with at most one distinct non-null value: the least is the greatest."""
    aggs = []
    for i, c in enumerate(cols):
        v = q(c) if isinstance(df.schema[c].dataType, T.AtomicType) else key(df, c)
        aggs.append((F.count(v) == 0).alias(f"e{i}"))
        aggs.append((F.min(v) == F.max(v)).alias(f"c{i}"))
    row = df.agg(*aggs).first() if cols else {}
    return [c for i, c in enumerate(cols) if row[f"e{i}"] or row[f"c{i}"]]
