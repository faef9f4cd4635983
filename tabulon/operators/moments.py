"""Sums of products over many columns: one matrix a task, added up by Spark.

An aggregate for each pair of columns makes a plan of p * p expressions; here a task turns its batches into matrix
products and hands on one matrix, whose cells are summed by a grouped aggregate.  Columns are shifted by their means
first, so that sums of squares don't cancel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.numeric import q
from tabulon.session import deliver

MOMENTS = ("n", "x", "y", "xx", "yy", "xy")


def finite(name: str):
    """The column as double, null where it is not finite."""
    v = q(name).cast("double")
    return F.when(F.abs(v) < float("inf"), v)


def means(df: DataFrame, cols: list[str]) -> np.ndarray:
    row = df.agg(*[F.avg(finite(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return np.array([row[f"m{i}"] or 0.0 for i in range(len(cols))])


def _cells(df: DataFrame, cols: list[str], shift: np.ndarray, of: Callable[[np.ndarray, np.ndarray], list[np.ndarray]],
           names: tuple[str, ...]) -> DataFrame:
    """(i, j, sums): the matrices that `of` makes of shifted values and their presence, summed over all batches; i <= j."""
    deliver(df.sparkSession)
    p = len(cols)
    schema = T.StructType([T.StructField("i", T.IntegerType()), *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
                there = ~np.isnan(x)
                part = of(np.where(there, x - shift, 0.0), there.astype(float))
                total = part if total is None else [a + c for a, c in zip(total, part)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(p), pa.int32()), *[pa.array([m[i, i:] for i in range(p)]) for m in total]], names=schema.names)

    rows = df.select(*[finite(c).alias(f"c{i}") for i, c in enumerate(cols)]).mapInArrow(run, schema)
    cells = rows.select("i", F.posexplode(F.arrays_zip(*names)).alias("k", "m")).select("i", (F.col("i") + F.col("k")).alias("j"), "m.*")
    return cells.groupBy("i", "j").agg(*[F.sum(n).alias(n) for n in names])


def pair_moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """(i, j, n, x, y, xx, yy, xy) for i <= j over the rows in which both columns are present (shifted by their means)."""
    def of(x: np.ndarray, there: np.ndarray) -> list[np.ndarray]:
        sums, squares = x.T @ there, (x * x).T @ there
        return [there.T @ there, sums, sums.T, squares, squares.T, x.T @ x]

    return _cells(df, cols, means(df, cols), of, MOMENTS)


def centred_gram(df: DataFrame, cols: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, sums of products of deviations) over rows in which every column is present."""
    whole = df.where(F.forall(F.array(*[finite(c) for c in cols]), lambda v: v.isNotNull()))
    shift = means(whole, cols)
    found = _cells(whole, cols, shift, lambda x, there: [there.T @ there, x.T @ there, x.T @ x], ("n", "x", "xy")).collect()  # p * p numbers
    n, sums, gram = 0, np.zeros(len(cols)), np.zeros((len(cols), len(cols)))
    for r in found:
        gram[r["i"], r["j"]] = gram[r["j"], r["i"]] = r["xy"]
        if r["i"] == r["j"]:
            n, sums[r["i"]] = int(r["n"]), r["x"]
    return n, shift + sums / max(n, 1), gram - np.outer(sums, sums) / max(n, 1)
