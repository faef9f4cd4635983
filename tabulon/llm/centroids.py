"""Centroid clustering by Shallot search: exact k-means rounds over integer vectors, most of them without any search.

Every vector carries its nearest and second-nearest centroid and two bounds: `upper` on the distance to the nearest,
`lower` on the distance to every other.  When the centroids move, the bounds move with them, and a vector whose upper
bound stays below the lower one keeps its centroid unseen.  Otherwise the search starts from the closer of the two
remembered centroids and walks that one's neighbours in order of their distance from it: a centroid that is nearer than the best second
known lies within (distance to the start + distance to that second), and this ball shrinks as better ones are found.
Distances of the centroids that are looked at are compared as integers, so ties go to the smaller number exactly; the
floating bounds are widened by more than their rounding.

A round is one pass over the vectors, partitioned as they are read; only centroids (k x d integers) go out and sums by cluster come
back.  The state of a round is a table in the shared folder, the one before it is deleted once the next is written.

Defined cases: vectors that are null, of another length, or hold null, non-finite or very large components (2^19 and
more: squared distances would pass a long) take no part.  Null ids never start a centroid but are clustered; repeated ids are separate
rows, and tie as starting centroids by their components.  Fewer than k vectors start fewer centroids; none gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import arrow_map, remove_tables
from tabulon.session import ensure_checkpoint_dir, scratch_path

K, ROUNDS, DIM, SCALE, SEED = 40, 5, 64, 256, 2
LARGEST = float(1 << 19)
#: More than all rounding of a bound: it is a sum of a few square roots and steps, each right to 1e-16 of itself.
SLACK = 1e-9

_VECTOR = [T.StructField("id", T.LongType()), T.StructField("x", T.ArrayType(T.IntegerType()))]
STATE = T.StructType([*_VECTOR, T.StructField("near", T.IntegerType()), T.StructField("second", T.IntegerType()),
                      T.StructField("upper", T.DoubleType()), T.StructField("lower", T.DoubleType())])


def squared(x: np.ndarray, centres: np.ndarray, which: np.ndarray) -> np.ndarray:
    gap = x - centres[which]
    return (gap * gap).sum(axis=1)


class Neighbours:
    """Of each centroid the others in order of distance, and those distances."""

    def __init__(self, centres: np.ndarray):
        gap = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2).astype(float))
        np.fill_diagonal(gap, -1.0)
        self.order = np.argsort(gap, axis=1, kind="stable")[:, 1:]
        self.gap = np.take_along_axis(gap, self.order, axis=1)


def search(x: np.ndarray, centres: np.ndarray, around: Neighbours, start: np.ndarray, other: np.ndarray
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The two nearest centroids of each row by (distance, number), from any two different ones known: (near, its squared
    distance, second, its squared distance)."""
    a, b = squared(x, centres, start), squared(x, centres, other)
    turn = (b < a) | ((b == a) & (other < start))
    near, second = np.where(turn, other, start), np.where(turn, start, other)
    d_near, d_second = np.where(turn, b, a), np.where(turn, a, b)
    centre, known = near.copy(), second.copy()
    reach = np.sqrt(d_near.astype(float))
    live = np.arange(len(x))
    for step in range(around.order.shape[1]):
        inside = around.gap[centre[live], step] <= (reach[live] + np.sqrt(d_second[live].astype(float))) * (1 + SLACK)
        live = live[inside]
        if not len(live):
            break
        j = around.order[centre[live], step]
        at = live[j != known[live]]
        j = j[j != known[live]]
        d = squared(x[at], centres, j)
        first = (d < d_near[at]) | ((d == d_near[at]) & (j < near[at]))
        then = ~first & ((d < d_second[at]) | ((d == d_second[at]) & (j < second[at])))
        up, to = at[first], j[first]
        second[up], d_second[up] = near[up], d_near[up]
        near[up], d_near[up] = to, d[first]
        up = at[then]
        second[up], d_second[up] = j[then], d[then]
    return near, d_near, second, d_second


def assign(x: np.ndarray, centres: np.ndarray, around: Neighbours, near: np.ndarray, second: np.ndarray, upper: np.ndarray,
           lower: np.ndarray) -> int:
    """Bring the state of some rows up to date with the centroids, in place; returns for how many rows a search was needed."""
    if len(centres) == 1:
        near[:] = 0
        return 0
    todo = np.flatnonzero(~(upper < lower))
    upper[todo] = np.sqrt(squared(x[todo], centres, near[todo]).astype(float)) * (1 + SLACK)
    todo = todo[~(upper[todo] < lower[todo])]
    near[todo], d_near, second[todo], d_second = search(x[todo], centres, around, near[todo], second[todo])
    upper[todo], lower[todo] = np.sqrt(d_near.astype(float)) * (1 + SLACK), np.sqrt(d_second.astype(float)) * (1 - SLACK)
    return len(todo)


def moved(near: np.ndarray, upper: np.ndarray, lower: np.ndarray, steps: np.ndarray) -> None:
    """Widen the bounds by how far the centroids went: the own one above, the farthest of the others below."""
    if len(steps) < 2:
        return
    order = np.argsort(-steps, kind="stable")
    others = np.where(near == order[0], steps[order[1]], steps[order[0]])
    upper += steps[near] * (1 + SLACK)
    lower -= others * (1 + SLACK)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _round(vectors: DataFrame, centres: np.ndarray, steps: np.ndarray | None) -> DataFrame:
    """One assignment; without `steps` the rows have no state yet."""
    dim = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = Neighbours(centres)
        for b in batches:
            x, m = _matrix(b.column(1), dim), b.num_rows
            if steps is None:
                near, second = np.zeros(m, np.int32), np.ones(m, np.int32)
                upper, lower = np.full(m, np.inf), np.zeros(m)
            else:
                near, second, upper, lower = (np.array(b.column(i)) for i in range(2, 6))
                moved(near, upper, lower, steps)
            assign(x, centres, around, near, second, upper, lower)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(near, pa.int32()), pa.array(second, pa.int32()),
                                              pa.array(upper), pa.array(lower)], names=STATE.names)

    return arrow_map(vectors, run, STATE)


def _means(state: DataFrame, centres: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each cluster's vectors; an empty cluster keeps its centroid."""
    k, dim = centres.shape
    schema = T.StructType([T.StructField("near", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in batches:
            near, x = np.array(b.column(0)), _matrix(b.column(1), dim)
            n += np.bincount(near, minlength=k)
            for c in np.unique(near):
                sums[c] += x[near == c].sum(axis=0)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))],
                                         names=schema.names)

    cells = (arrow_map(state.select("near", "x"), run, schema).select("near", "n", F.posexplode("sums").alias("j", "v"))
             .groupBy("near", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"), F.sum("n").alias("n")).collect())
    out = centres.copy()
    for r in cells:  # k x d of them
        out[r["near"], r["j"]] = int(r["v"]) // r["n"]
    return out


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    """(id, x) of the rows that take part."""
    kept = (df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
            .where((F.size("v") == dim) & F.forall("v", lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)) & ~F.isnan(c))))
    return kept.select("id", F.transform("v", lambda c: F.floor(c * scale).cast("int")).alias("x"))


def cluster(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM,
            scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance) of each vector, final centroids); the result is a table in the shared folder."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    paths = [scratch_path(spark, "shallot")]
    integer_vectors(df, id_col, vec_col, dim, scale).write.parquet(paths[0])
    vectors = spark.read.parquet(paths[0])
    drawn = (vectors.where(F.col("id").isNotNull())
             .orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), "x").select("x").limit(k).collect())
    if not drawn:
        drawn = vectors.orderBy("x").select("x").limit(1).collect()  # all ids are null: one cluster around the least vector
    if not drawn:
        return spark.createDataFrame([], "id long, cluster int, distance long"), np.zeros((0, dim), np.int64)
    centres, steps = np.array([r["x"] for r in drawn], np.int64), None
    state = vectors
    for _ in range(rounds):
        paths.append(scratch_path(spark, "shallot"))
        _round(state, centres, steps).write.parquet(paths[-1])
        remove_tables(spark, paths[-2:-1])
        state = spark.read.schema(STATE).parquet(paths[-1])
        new = _means(state, centres)
        steps, centres = np.sqrt(((new - centres) ** 2).sum(axis=1).astype(float)), new
    out = T.StructType([T.StructField("id", T.LongType()), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = np.array(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(squared(_matrix(b.column(1), dim), centres, near))], names=out.names)

    paths.append(scratch_path(spark, "shallot"))
    arrow_map(_round(state, centres, steps), measured, out).write.parquet(paths[-1])
    remove_tables(spark, paths[-2:-1])
    return spark.read.schema(out).parquet(paths[-1]), centres


def op13(embeddings: DataFrame) -> DataFrame:
    spark = embeddings.sparkSession
    found, centres = cluster(embeddings)
    # At most as many rows as centroids: the inertia of each cluster and the hash of its final centroid.
    sums = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    fits = lambda v: v if v < 1 << 63 else None
    small = F.broadcast(spark.createDataFrame(
        [(i, fits(d), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, centres[i].tolist())).encode()).hexdigest()) for i, d in sums.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return found.join(small, "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    steps = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, embedding, [CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS x
  FROM embeddings
  WHERE len(embedding) = {DIM} AND len([1 FOR c IN embedding IF c IS NOT NULL AND isfinite(c) AND abs(c) < {LARGEST:.0f}]) = {DIM}),
w AS MATERIALIZED (SELECT rid, unnest(range({DIM})) AS d, unnest(x) AS x FROM v),
s AS (SELECT x, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), x) - 1 AS c FROM v WHERE vec_id IS NOT NULL QUALIFY c < {K}),
c0 AS MATERIALIZED (SELECT c, unnest(range({DIM})) AS d, unnest(x) AS x FROM s)"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT rid, c, dist FROM (SELECT rid, c, sum((w.x - c{r}.x) * (w.x - c{r}.x)) AS dist FROM w JOIN c{r} USING (d) GROUP BY rid, c)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY dist, c) = 1)""")
        if r < ROUNDS:
            steps.append(f"""
m{r} AS (SELECT c, d, sum(x) AS t, count(*) AS n FROM w JOIN a{r} USING (rid) GROUP BY c, d),
c{r + 1} AS MATERIALIZED (SELECT c, d, CAST(coalesce((t - ((t % n) + n) % n) // n, x) AS BIGINT) AS x FROM c{r} LEFT JOIN m{r} USING (c, d))""")
    return f"""WITH {",".join(steps)},
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(dist AS BIGINT) AS distance, CAST(sum(dist) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(dist) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN v USING (rid) JOIN h USING (c)"""


SQL = _sql()
