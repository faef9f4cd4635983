"""Embedding whitening by shifted CholeskyQR: Gram passes, triangular solves, and an SVD of the composed R.

Entries become integers (`floor(scale * c) + offset`), so sums, means and deviations are exact.  A row is centred before
anything is multiplied: with S = n q + r, an entry is (x - q) - r / n, one rounding away from the truth whatever the
offset.  Each pass solves the centred rows through the triangles found so far, in the tasks, and adds up the d x d Gram
matrix of the result; its Cholesky factor is the next triangle.  The first factor gets the shift that makes it exist for
every matrix of full numeric rank, the following ones restore orthogonality.  The product of the triangles is the R of
the centred matrix: its singular values give the eigenvalues, its right singular vectors the components.

No row leaves its task: what travels is a d x d matrix a task, summed by Spark; the driver holds d x d numbers.
Nothing is written on the way, every pass starts from the input, so a lost executor costs its tasks only.

Defined cases: rows whose vector is null, holds null or non-finite entries, or entries of 2^40 and more (whose integers
could not be summed exactly), take no part, nor do vectors of another length than the most frequent one (of equally
frequent ones the longer).  Null and repeated ids are rows like others.  Directions without spread (singular value below the
rounding error of the largest) are no components, so equal vectors give no rows; an empty table gives none.  A deviation
that doesn't fit in a long is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import arrow_map

SCALE, OFFSET = 1024, 100_000
LARGEST = float(1 << 40)
#: Three passes orthogonalise any matrix of full numeric rank; more are only spent where the rank is not full.
PASSES = 5
U = float(np.finfo(np.float64).eps) / 2


@dataclass
class Whitening:
    """A fitted model: exact sums per dimension, components (one a column) and the eigenvalues of the covariance."""
    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    scale: int = SCALE
    offset: int = OFFSET
    passes: int = 0

    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace if self.trace else self.eigenvalues


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): ids as long and vectors as doubles, of the rows that take part."""
    return (df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
            .where(F.col("v").isNotNull() & F.forall("v", lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)) & ~F.isnan(c))))


def _integers(column: pa.Array, dim: int, scale: int, offset: int) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.floor(scale * v).astype(np.int64) + offset


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    q, r = zip(*(divmod(s, n) for s in sums))
    return (x - np.array(q, np.int64)) - np.array([v / n for v in r])


def solved(y: np.ndarray, triangles: list[np.ndarray]) -> np.ndarray:
    """y R1^-1 R2^-1 ... by forward substitution over the columns."""
    for r in triangles:
        out = np.empty_like(y)
        for j in range(len(r)):
            out[:, j] = (y[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        y = out
    return y


def _sum_over_tasks(vectors: DataFrame, height: int, of_batch: Callable[[pa.Array], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum over all batches of a matrix with `height` rows: one matrix a task, then added up by Spark."""
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("row", T.ArrayType(
        T.DoubleType() if kind == "double" else T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            if b.num_rows:
                total = total + of_batch(b.column(0))
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array(range(height), pa.int32()), pa.array(list(total))], names=["i", "row"])

    add = F.sum("v") if kind == "double" else F.sum(F.col("v").cast("decimal(38,0)"))
    cells = (arrow_map(vectors.select("v"), run, schema).select("i", F.posexplode("row").alias("j", "v"))
             .groupBy("i", "j").agg(add.alias("v")).collect())
    out = np.zeros((height, max((r["j"] for r in cells), default=-1) + 1), float if kind == "double" else object)
    for r in cells:
        out[r["i"], r["j"]] = r["v"] if kind == "double" else int(r["v"])
    return out


def triangular_factor(vectors: DataFrame, n: int, sums: list[int], scale: int, offset: int) -> tuple[np.ndarray, int]:
    """R of the centred matrix, and the number of Gram passes it took."""
    dim, triangles = len(sums), []
    eye = np.eye(dim)
    for count in range(1, PASSES + 1):
        def gram(column: pa.Array, triangles=tuple(triangles)) -> np.ndarray:
            q = solved(centred(_integers(column, dim, scale, offset), n, sums), list(triangles))
            return q.T @ q

        g = _sum_over_tasks(vectors, dim, gram)
        g = (g + g.T) / 2
        if not g.any():  # all rows are equal
            return g, count
        if triangles and np.abs(g - eye).max() <= 16 * dim * U:
            break
        shift = 0.0 if triangles else _shift(n, dim, g)
        while True:
            try:
                triangles.append(np.linalg.cholesky(g + shift * eye).T)
                break
            except np.linalg.LinAlgError:  # not of full rank: the directions without spread stay below the shift
                shift = max(10 * shift, _shift(n, dim, g))
    r = eye
    for t in triangles:
        r = t @ r
    return r, count


def _shift(n: int, dim: int, g: np.ndarray) -> float:
    return 11 * (n * dim + dim * (dim + 1)) * U * float(np.linalg.norm(g, 2)) or 1.0


def fit(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 8, scale: int = SCALE,
        offset: int = OFFSET) -> Whitening | None:
    """The model over all vectors that take part; None if there are none."""
    vectors = valid_vectors(df, id_col, vec_col)
    length = vectors.groupBy(F.size("v").alias("dim")).count().where("dim > 0").orderBy(F.desc("count"), F.desc("dim")).first()
    if length is None:
        return None
    dim, n = length["dim"], length["count"]
    vectors = vectors.where(F.size("v") == dim)

    def halves(column: pa.Array) -> np.ndarray:
        x = _integers(column, dim, scale, offset)
        return np.stack([(x >> 26).sum(axis=0), (x & ((1 << 26) - 1)).sum(axis=0)])

    high, low = _sum_over_tasks(vectors, 2, halves, "long")
    sums = [(int(h) << 26) + int(b) for h, b in zip(high, low)]
    r, passes = triangular_factor(vectors, n, sums, scale, offset)
    _, sigma, rows = np.linalg.svd(r)
    spread = sigma > max(n, dim) * 2 * U * sigma[0] if sigma[0] > 0 else np.zeros(dim, bool)
    spread[components:] = False
    return Whitening(n, sums, rows[spread].T.copy(), sigma[spread] ** 2 / n, float((sigma ** 2).sum() / n), scale, offset, passes)


def _projected(column: pa.Array, model: Whitening) -> np.ndarray:
    y = centred(_integers(column, len(model.sums), model.scale, model.offset), model.n, model.sums)
    return y @ model.components / np.sqrt(model.eigenvalues)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Of each row the sum over dimensions of (n x - S)^2, exactly; null where it doesn't fit in a long."""
    ends = [(int(x[:, j].min()), int(x[:, j].max())) for j in range(len(sums))] if len(x) else []
    if sum(max(abs(n * low - s), abs(n * high - s)) ** 2 for (low, high), s in zip(ends, sums)) >= 1 << 63:
        exact = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(axis=1)
        return pa.array([int(v) if v < 1 << 63 else None for v in exact], pa.int64())
    return pa.array(((x * n - np.array(sums, np.int64)) ** 2).sum(axis=1), pa.int64())


def identity_error(df: DataFrame, model: Whitening, *, id_col: str = "vec_id", vec_col: str = "embedding") -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, from a pass of its own."""
    k = len(model.eigenvalues)
    vectors = valid_vectors(df, id_col, vec_col).where(F.size("v") == len(model.sums))

    def moments(column: pa.Array) -> np.ndarray:
        w = _projected(column, model)
        return np.vstack([w.sum(axis=0), w.T @ w])

    total = _sum_over_tasks(vectors, k + 1, moments) / model.n
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(k)).max())


OUT = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
                    T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
                    T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])


def transform(df: DataFrame, model: Whitening | None, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row for each vector that takes part and each component, with the model's measures beside it."""
    if model is None or not len(model.eigenvalues):
        return df.sparkSession.createDataFrame([], OUT)
    k, explained = len(model.eigenvalues), model.explained()
    error = identity_error(df, model, id_col=id_col, vec_col=vec_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.num_rows
            x = _integers(b.column(1), len(model.sums), model.scale, model.offset)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n), pa.int64()),
                 deviations(x, model.n, model.sums).take(each), pa.array(_projected(b.column(1), model).ravel()),
                 pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))], names=OUT.names)

    vectors = valid_vectors(df, id_col, vec_col).where(F.size("v") == len(model.sums))
    return arrow_map(vectors, run, OUT)


def op12(embeddings: DataFrame) -> DataFrame:
    return transform(embeddings, fit(embeddings))
