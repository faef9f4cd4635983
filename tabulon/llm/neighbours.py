"""Approximate nearest neighbours by largest inner product: inverted lists and an adaptive dimension scan.

k-means centroids, fitted on a bounded sample (SAMPLE rows), cut the vectors into lists; every row is indexed in the
list of its nearest centroid.  A query probes the lists of the centroids nearest to it.  Inside a list the vectors
are rotated at random and scanned in column blocks: from a partial distance over the first d of D rotated columns a
hypothesis test tells whether the whole distance can still be below the one that the current k-th best inner
product stands for, and most candidates are abandoned early.  The survivors get their exact inner product in
double precision on the original vectors.

A list is dealt into cells of bounded rows, cells into shards and queries into groups, so one hot list (many equal
vectors) spreads over many tasks; each (shard, group) returns at most k rows for a query.  Vectors that are null, zero,
of another length than most, or hold null or non-finite components take no part.  Rows without an id take no part.
Ties go to the smaller id.  Rows are told apart by a row number of the written lists: every row of a repeated id is a query
of its own (with its own k rows of the result) and a candidate of the others.
"""

from __future__ import annotations

import pickle
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabulon.llm.common import arrow_map, deliver
from tabulon.session import ensure_checkpoint_dir, scratch_path

SAMPLE = 20_000
#: Share of the lists that a query probes; vectors without clusters need many for a recall of 0.9.
PROBE_SHARE = 0.65
CELL_ROWS, SHARD_ROWS, GROUP_QUERIES = 2048, 8192, 2048
COLUMN_BLOCK = 16
#: Width of the test: a candidate is abandoned when its scaled partial distance is beyond (1 + EPSILON / sqrt(d)) times.
EPSILON = 2.1
SEEDS = 48


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        used = n > 0
        centres[used] = total[used] / n[used][:, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([np.argmin(half - x[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(x), 4096)]
                          or [np.zeros(0, np.int64)])


class Best:
    """The k best (score, id) found so far of each of some queries."""

    def __init__(self, n: int, k: int):
        self.k, self.n = k, n
        self.query, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.bar = np.full(n, -np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        query = np.concatenate([self.query, query])
        ids, score = np.concatenate([self.id, ids]), np.concatenate([self.score, score])
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        top = place < self.k
        self.query, self.id, self.score = query[top], ids[top], score[top]
        last = place[top] == self.k - 1
        self.bar[self.query[last]] = self.score[last]


def scan_list(best: Best, asked: np.ndarray, q_rows: np.ndarray, q: np.ndarray, rq: np.ndarray, c_rows: np.ndarray, c_ids: np.ndarray,
              c: np.ndarray, rc: np.ndarray, epsilon: float = EPSILON) -> None:
    """Scan one list for the queries `asked`; the query's own row is left out."""
    dim, k = q.shape[1], best.k
    d = min(COLUMN_BLOCK, dim)
    dot = rq[asked, :d] @ rc[:, :d].T
    own = q_rows[asked][:, None] == c_rows[None]
    bar = best.bar[asked]
    open_ = np.flatnonzero(np.isneginf(bar))
    if len(open_) and len(c) > k + 1:
        # No bar yet: the candidates that look best in the first column block get whole products and set one.
        n_seed = min(len(c), max(SEEDS, k + 2))
        guess = np.where(own[open_], -np.inf, dot[open_])
        seeds = np.argpartition(-guess, n_seed - 1, axis=1)[:, :n_seed]
        score = (q[asked[np.repeat(open_, n_seed)]] * c[seeds.ravel()]).sum(axis=1).reshape(len(open_), n_seed)
        score[np.take_along_axis(own[open_], seeds, axis=1)] = -np.inf
        bar = bar.copy()
        bar[open_] = np.partition(score, n_seed - k, axis=1)[:, n_seed - k]
    qq, cc = (rq[asked] ** 2).sum(axis=1), (rc ** 2).sum(axis=1)
    partial = (rq[asked, :d] ** 2).sum(axis=1)[:, None] + (rc[:, :d] ** 2).sum(axis=1)[None] - 2 * dot
    # the squared distance at which the inner product is the bar
    reach = np.maximum(qq[:, None] + cc[None] - 2 * bar[:, None], 0.0)
    live = ~own & (partial * (dim / d) <= reach * (1 + epsilon / sqrt(d)) ** 2 + 1e-9)
    at_q, at_c = np.nonzero(live)
    left, limit = partial[at_q, at_c], reach[at_q, at_c]
    while d < dim:
        e = min(d + COLUMN_BLOCK, dim)
        left = left + ((rq[asked[at_q], d:e] - rc[at_c, d:e]) ** 2).sum(axis=1)
        d = e
        slack = 1.0 if d == dim else (1 + epsilon / sqrt(d)) ** 2
        keep = left * (dim / d) <= limit * (slack * (1 + 1e-9)) + 1e-9
        at_q, at_c, left, limit = at_q[keep], at_c[keep], left[keep], limit[keep]
    if len(at_q):
        best.add(asked[at_q], c_ids[at_c], (q[asked[at_q]] * c[at_c]).sum(axis=1))


def _rows(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def search(df: DataFrame, queries, *, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
           probe_share: float = PROBE_SHARE, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest; `queries` is a condition on the rows."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    out_schema = "query_id long, rank int, vec_id long, score double"
    vec = F.col(vec_col).cast("array<double>")
    clean = (df.select(F.col(id_col).cast("long").alias("id"), vec.alias("v"), queries.alias("is_query"))
             .where(F.col("id").isNotNull() & F.col("v").isNotNull()
                    & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                    & F.exists("v", lambda x: x != 0)))
    lengths = clean.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], out_schema)
    dim, rows = lengths["n"], lengths["count"]
    clean = clean.where(F.size("v") == dim)
    step = max(1, rows // sample)
    drawn = clean.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(step)) == 0).select("v").toArrow()["v"]
    if len(drawn) == 0:
        drawn = clean.select("v").limit(1).toArrow()["v"]  # a few rows, none drawn: one list
    x = drawn.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    centres = kmeans(x, max(1, int(2 * sqrt(rows))))
    held = spark.sparkContext.broadcast(pickle.dumps((centres, rotation(dim))))
    probes = min(len(centres), max(1, ceil(probe_share * len(centres))))

    def assign(batches):
        centres, _ = pickle.loads(held.value)
        for b in batches:
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([r.tobytes() for r in v], pa.binary()), pa.array(nearest(v, centres), pa.int32()),
                 b.column("is_query")], names=["id", "v", "list", "is_query"])

    path = scratch_path(spark, "ann-lists")
    arrow_map(clean.select("id", "v", F.coalesce("is_query", F.lit(False)).alias("is_query")), assign, T.StructType([
        T.StructField("id", T.LongType()), T.StructField("v", T.BinaryType()), T.StructField("list", T.IntegerType()),
        T.StructField("is_query", T.BooleanType())])).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    lists = spark.read.parquet(path)
    sizes = np.zeros(len(centres), np.int64)
    for r in lists.groupBy("list").count().collect():  # at most as many rows as centroids
        sizes[r["list"]] = r["count"]

    def choose(batches):
        """A query's nearest lists: the probe share, and on until they hold k rows besides the query's own."""
        centres, _ = pickle.loads(held.value)
        for b in batches:
            order = np.argsort(-(_rows(b.column("v"), dim) @ centres.T), axis=1, kind="stable")
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            taken = (np.arange(len(centres)) < probes) | (before < k + 1)
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("id"), b.column("v"),
                 pa.array([o[t].tolist() for o, t in zip(order, taken, strict=True)], pa.list_(pa.int32()))], names=["row", "id", "v", "probe"])

    queried = lists.where("is_query").select("row", "id", "v")
    asks = arrow_map(queried, choose, T.StructType([
        T.StructField("row", T.LongType()), T.StructField("id", T.LongType()), T.StructField("v", T.BinaryType()),
        T.StructField("probe", T.ArrayType(T.IntegerType()))]))
    # A small table by list (at most as many rows as centroids): into how many cells of bounded rows it is dealt.
    cells = F.broadcast(spark.read.parquet(path).groupBy("list").agg(F.ceil(F.count("*") / CELL_ROWS).alias("cells")))
    shards, groups = ceil(rows / SHARD_ROWS), max(1, ceil(queried.count() / GROUP_QUERIES))
    left = (lists.join(cells, "list")
            .withColumn("shard", F.pmod(F.xxhash64("list", F.pmod(F.xxhash64("id", "v"), F.col("cells"))), F.lit(shards)).cast("int"))
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
            .select("shard", "part", "list", "row", "id", "v"))
    right = (asks.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
             .select("shard", "part", "probe", "row", "id", "v"))
    deliver(spark)

    def scan(have: pa.Table, want: pa.Table) -> pa.Table:
        best = Best(want.num_rows, k)
        if have.num_rows and want.num_rows:
            centres, turn = pickle.loads(held.value)
            have = have.sort_by("list")
            q_rows, c_rows, c_ids, of_list = want["row"].to_numpy(), have["row"].to_numpy(), have["id"].to_numpy(), have["list"].to_numpy()
            q, c = _rows(want["v"], dim), _rows(have["v"], dim)
            rq, rc = q @ turn, c @ turn
            probe = np.zeros((len(q), len(centres)), bool)
            asked = want["probe"].combine_chunks()
            probe[np.repeat(np.arange(len(q)), asked.value_lengths().to_numpy()), asked.flatten().to_numpy()] = True
            names, first = np.unique(of_list, return_index=True)
            for name, a, b in zip(names, first, [*first[1:], len(c)], strict=True):
                every = np.flatnonzero(probe[:, name])
                for i in range(0, len(every), 512):
                    scan_list(best, every[i : i + 512], q_rows, q, rq, c_rows[a:b], c_ids[a:b], c[a:b], rc[a:b])
        of = lambda name: want[name].to_numpy()[best.query] if len(best.query) else pa.array([], pa.int64())
        return pa.table({"query_row": of("row"), "query_id": of("id"),
                         "vec_id": pa.array(best.id, pa.int64()), "score": pa.array(best.score, pa.float64())})

    by = ["shard", "part"]
    hits = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(
        scan, "query_row long, query_id long, vec_id long, score double")
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return (hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op4(embeddings: DataFrame) -> DataFrame:
    return search(embeddings, F.col("vec_id") % 20 == 0)
