"""N-gram Jaccard join by chosen paths.

A document is the set of its word 5-grams (a text of fewer words: one gram of all of them; words are
`[^\\x20\\x09-\\x0D]+`, unchanged).  Equal sets are one node.  Nodes are embedded by COORDINATES min-hashes; a token is a
coordinate with its value (32 bits of it at the root, so that buckets of unlike nodes don't fill up as the table grows, 16
below).  From the root, each of RUNS runs samples coordinates, 1/threshold of them on average, and splits the
nodes by the tokens they have there; buckets that stay over LIMIT are split again along sampled coordinates (at least one), level by level.
In a small bucket all pairs are compared by their sketches, the ones that may reach the threshold by their whole sets.
A pair of similarity 0.8 shares no bucket of a run with probability e^-1, so 16 runs leave about one pair in ten
million; of the shared buckets that are split, each loses the pair with probability 0.36 at most.

A pair that shares several first-level buckets is handled in the first of them that was not split, and in every bucket
below a split one that it shares; its links are made unique.  Pairs are never rows: each node
of a bucket gets its verified neighbours as one packed list, and an edge to the smallest node it is linked with
there; classes are the connected components of those edges.

Null texts, texts without words and rows without an id are classes of their own without links.  Repeated rows are copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import arrow_map, deliver, fresh, parts_for
from tabulon.llm.words import SPACE, Words, byte_table, mix, shingle_hashes, text_blocks
from tabulon.session import ensure_checkpoint_dir, materialize, scratch_path

GRAM, THRESHOLD = 5, 0.8
COORDINATES, RUNS, LIMIT, DEPTH = 64, 16, 2048, 8
#: Below the threshold by this much, a sketch says that a pair can't reach it (about four standard deviations).
SLACK = 0.19
_TABLES = byte_table(drop=SPACE)
U16, U32 = np.uint16, np.uint32


def _multipliers() -> np.ndarray:
    return np.random.default_rng(17).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def first_coordinates(runs: int = RUNS, threshold: float = THRESHOLD) -> np.ndarray:
    """The coordinates that the runs sample at the root, each once, in the order of the runs."""
    rng = np.random.default_rng(23)
    drawn = []
    for _ in range(runs):
        picked = np.flatnonzero(rng.random(COORDINATES) < 1 / (threshold * COORDINATES))
        drawn += picked.tolist() or [int(rng.integers(COORDINATES))]
    return np.array(list(dict.fromkeys(drawn)))


def gram_sets(texts: pa.Array, gram: int = GRAM) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, distinct grams text by text, bounds) for blocks of texts; the grams of a text are sorted."""
    for i, j, data, bounds in text_blocks(texts):
        words = Words(data, bounds, _TABLES)
        n = words.last - words.first
        grams = shingle_hashes(words.hash, gram)
        count = np.where(n >= gram, n - gram + 1, np.minimum(n, 1))
        text = np.repeat(np.arange(j - i), count)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = words.first[text] + step
        h = np.zeros(len(at), np.uint64)
        long = n[text] >= gram
        h[long] = grams[at[long]]
        for t in np.flatnonzero((n > 0) & (n < gram)):  # few words: one gram
            x = np.full(1, n[t], np.uint64)
            for k in range(words.first[t], words.last[t]):
                x = mix(x + words.hash[k : k + 1])
            h[text == t] = x
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        h, text = h[new], text[new]
        yield i, j, h, np.searchsorted(text, np.arange(j - i + 1))


SKETCHED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("key", T.LongType()), T.StructField("node", T.LongType()),
                         T.StructField("n", T.IntegerType()), T.StructField("sketch", T.BinaryType()),
                         T.StructField("tokens", T.BinaryType())])


def _sketches(batches: Iterator[pa.RecordBatch], gram: int, order: np.ndarray) -> Iterator[pa.RecordBatch]:
    turns = _multipliers()
    places = {int(c): k for k, c in enumerate(order)}
    for batch in batches:
        rows = batch.num_rows
        node, n = np.zeros(rows, np.int64), np.zeros(rows, np.int32)
        sketch, tokens = np.zeros((rows, COORDINATES), U16), np.zeros((rows, len(order)), U32)
        for i, j, h, bounds in gram_sets(batch.column(2), gram):
            size = np.diff(bounds)
            n[i:j] = size
            some = np.flatnonzero(size)
            if not len(some):
                continue
            start = bounds[some]
            node[i + some] = mix(np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), start)
                                 + np.uint64(7) * np.bitwise_xor.reduceat(mix(h + np.uint64(9)), start)).view(np.int64)
            for c, turn in enumerate(turns):
                value = mix(np.minimum.reduceat((h * turn) >> np.uint64(8), start))
                sketch[i + some, c] = value >> np.uint64(48)
                if c in places:
                    tokens[i + some, places[c]] = (value >> np.uint64(16)) & np.uint64(0xFFFFFFFF)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(node, mask=n == 0), pa.array(n),
             pa.array([s.tobytes() for s in sketch], pa.binary()), pa.array([t.tobytes() for t in tokens], pa.binary())], names=SKETCHED.names)


def _path(above: np.ndarray, coord: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mix(mix(above + coord.astype(np.uint64) + np.uint64(1)) ^ value + np.uint64(1 << 20)).view(np.int64)


def _roots(batches: Iterator[pa.RecordBatch], order: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(node, tokens) -> the first-level paths, with the place of their coordinate in `order`."""
    for batch in batches:
        node = batch.column(0).to_numpy()
        value = np.frombuffer(b"".join(batch.column(1).to_pylist()), U32).astype(np.uint64)
        place = np.tile(np.arange(len(order)), len(node))
        path = _path(np.zeros(len(value), np.uint64), order[place], value)
        yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(place, pa.int32()), pa.array(np.repeat(node, len(order)))],
                                         names=["path", "coord", "node"])


def _paths(batches: Iterator[pa.RecordBatch], order: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """(path, coord, node, sketch) -> the child paths along the coordinates that the path samples."""
    for batch in batches:
        sketch = np.frombuffer(b"".join(batch.column(3).to_pylist()), U16).reshape(-1, COORDINATES).astype(np.uint64)
        node = batch.column(2).to_numpy()
        above = batch.column(0).to_numpy().view(np.uint64)
        draw = mix(above[:, None] + (np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None])
        taken = draw < np.uint64(int((1 << 64) * 2 / COORDINATES))
        taken[np.arange(len(draw)), draw.argmin(axis=1)] = True  # every path goes on
        at, coord = np.nonzero(taken)
        path = _path(above[at], coord, sketch[at, coord])
        yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(np.full(len(at), -1), pa.int32()), pa.array(node[at])],
                                         names=["path", "coord", "node"])


def _maybe(sketch: np.ndarray, tokens: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, coord: np.ndarray, split: np.ndarray,
           threshold: float) -> np.ndarray:
    """Which pairs may reach the threshold and have no common first-level bucket before this one, split ones aside."""
    bit = np.int64(1) << np.arange(tokens.shape[1], dtype=np.int64)
    out = np.zeros(len(a), bool)
    least = int(np.ceil((threshold - SLACK) * COORDINATES))
    for i in range(0, len(a), 1 << 16):
        x, y = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
        fits = np.minimum(n[x], n[y]) >= threshold * np.maximum(n[x], n[y])
        at = np.flatnonzero(fits)
        at = at[(sketch[x[at]] == sketch[y[at]]).sum(axis=1) >= least]
        whole = (split[x[at], None] & bit) == 0  # a common bucket is split for both or for none
        first = np.argmax((tokens[x[at]] == tokens[y[at]]) & whole, axis=1)
        place = coord[x[at]]
        out[i + at[(place < 0) | (place == first)]] = True
    return out


def candidates(got: pa.Table, sketch: np.ndarray, tokens: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (a before b) that share a bucket and may reach the threshold; the rows are sorted by path."""
    path, coord, n = (got[x].to_numpy() for x in ("path", "coord", "n"))
    split = got["split"].to_numpy() if "split" in got.column_names else np.zeros(len(path), np.int64)
    start = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]])) if len(path) else np.zeros(0, int)
    size = np.diff([*start, len(path)]).astype(np.int64)
    left, right = [], []
    for s in np.unique(size[size > 1]):
        base = start[size == s]
        if s <= 64:  # all buckets of one size at once
            x, y = np.triu_indices(s, 1)
            step = max(1, (1 << 18) // len(x))
            tasks = [((base[k : k + step, None] + x).ravel(), (base[k : k + step, None] + y).ravel()) for k in range(0, len(base), step)]
        else:
            tasks = ((np.repeat(f + i, s - i - 1), f + np.arange(i + 1, s)) for f in base for i in range(s - 1))
        for a, b in tasks:
            if len(a):
                ok = _maybe(sketch, tokens, n, a, b, coord, split, threshold)
                left.append(a[ok])
                right.append(b[ok])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def verify(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each pair's sets reach the threshold."""
    size = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(ids.max() + 1, np.int64)
    out = np.zeros(len(a), bool)
    order = np.argsort(a, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], a[order][1:] != a[order][:-1]]))
    for x, y in zip(cut, [*cut[1:], len(a)], strict=True):
        mine = order[x:y]
        one = ids[bounds[a[mine[0]]] : bounds[a[mine[0]] + 1]]
        mark[one] = 1
        for k in range(0, len(mine), 256):
            some = mine[k : k + 256]
            length = size[b[some]]
            start = np.cumsum(length) - length
            at = np.repeat(bounds[b[some]] - start, length) + np.arange(length.sum())
            both = np.add.reduceat(mark[ids[at]], start)
            out[some] = both >= threshold * (len(one) + length - both) - 1e-9
        mark[one] = 0
    return out


LINKS = T.StructType([T.StructField("node", T.LongType()), T.StructField("root", T.LongType()),
                      T.StructField("others", T.BinaryType()), T.StructField("copies", T.BinaryType())])


def _members(got: pa.Table, order: np.ndarray) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """The rows of some buckets sorted by path and node, their nodes, sketches and tokens."""
    got = got.sort_by([("path", "ascending"), ("node", "ascending")])
    packed = lambda name, dtype, width: np.frombuffer(b"".join(got[name].to_pylist()), dtype).reshape(-1, width)
    return got, got["node"].to_numpy(), packed("sketch", U16, COORDINATES), packed("tokens", U32, len(order))


def _probe(got: pa.Table, order: np.ndarray, threshold: float) -> pa.Table:
    """The members of a range of buckets that have a candidate there."""
    got, _, sketch, tokens = _members(got, order)
    a, b = candidates(got, sketch, tokens, threshold)
    return got.take(pa.array(np.unique(np.concatenate([a, b])))).select(["path", "coord", "node"])


def _verified(got: pa.Table, order: np.ndarray, threshold: float) -> pa.Table:
    """The links in a range of buckets, by node."""
    got, node, sketch, tokens = _members(got, order)
    copies = got["copies"].to_numpy().astype(np.int64)
    a, b = candidates(got, sketch, tokens, threshold)
    other = node[a] != node[b]  # repeated rows of a node
    a, b = a[other], b[other]
    rows = []
    if len(a):
        ok = verify([np.frombuffer(x, np.uint64) for x in got["grams"].to_pylist()], a, b, threshold)
        names, first, number = np.unique(node, return_index=True, return_inverse=True)
        pair = np.unique(number[a[ok]] * len(names) + number[b[ok]])
        a, b = np.divmod(pair, len(names))
        root = list(range(len(names)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = find(x), find(y)
            root[max(p, q)] = min(p, q)
        one, two = np.concatenate([a, b]), np.concatenate([b, a])
        turn = np.argsort(one, kind="stable")
        one, two = one[turn], two[turn]
        cut = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]])) if len(one) else []
        for x, y in zip(cut, [*cut[1:], len(one)] if len(one) else [], strict=True):
            rows.append((int(names[one[x]]), int(names[find(int(one[x]))]), names[two[x:y]].tobytes(),
                         copies[first[two[x:y]]].tobytes()))
    return pa.table({f.name: pa.array([r[k] for r in rows], t) for k, (f, t) in
                     enumerate(zip(LINKS.fields, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True))})


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component of the edges (node, root).

    Each round takes the smallest label among a node and its neighbours, then the label of that label; the rounds
    grow with the logarithm of the longest shortest path.
    """
    both = materialize(edges.select(F.col("node").alias("u"), F.col("root").alias("v"))
                       .unionAll(edges.select(F.col("root").alias("u"), F.col("node").alias("v"))).distinct())
    labels = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), F.col("label").alias("other")), "v")
        low = near.groupBy("u").agg(F.min("other").alias("low"))
        step = labels.join(low, "u").select("u", F.least("label", "low").alias("to"), "label")
        jump = step.alias("s").join(labels.select(F.col("u").alias("to"), F.col("label").alias("next")), "to", "left")
        new = materialize(jump.select("u", F.least("to", F.coalesce("next", "to")).alias("label"),
                                      (F.least("to", F.coalesce("next", "to")) != F.col("label")).alias("moved")))
        labels = new.select("u", "label")
        if not new.where("moved").head(1):
            return labels.select(F.col("u").alias("node"), "label")


def _classes(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM,
                      threshold: float = THRESHOLD, limit: int = LIMIT) -> DataFrame:
    """The rows of similar_documents with `key` (hash of id and text) and `class_key`, the key of the row that stands for the class.

    Written on the way, in the shared folder: the sketches and tokens (about 210 bytes a document) and small link tables.
    """
    spark: SparkSession = df.sparkSession
    ensure_checkpoint_dir(spark)
    deliver(spark)
    order = first_coordinates(threshold=threshold)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    path = scratch_path(spark, "jaccard-sketches")
    arrow_map(docs, lambda b: _sketches(b, gram, order), SKETCHED).write.parquet(path)
    sketched = spark.read.parquet(path)
    path = scratch_path(spark, "jaccard-nodes")
    (sketched.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull()).groupBy("node")
     .agg(F.min(F.struct("doc_id", "key")).alias("least"), F.count("*").cast("int").alias("copies"), F.first("n").alias("n"),
          F.first("sketch").alias("sketch"), F.first("tokens").alias("tokens"))
     .select("node", "n", "copies", "sketch", "tokens", F.col("least.doc_id").alias("doc_id"), F.col("least.key").alias("key"))
     .write.parquet(path))
    nodes = spark.read.parquet(path)

    paths = T.StructType([T.StructField("path", T.LongType()), T.StructField("coord", T.IntegerType()), T.StructField("node", T.LongType())])
    split = lambda rows: arrow_map(rows.select("path", "coord", "node", "sketch"), _paths, paths)
    rows = arrow_map(nodes.select("node", "tokens"), lambda b: _roots(b, order), paths)
    buckets, known, extra = None, nodes, []
    for depth in range(DEPTH):
        sized = rows.groupBy("path").agg(F.count("*").alias("size")).where(F.col("size") > 1)
        where = scratch_path(spark, f"jaccard-buckets-{depth}")
        rows.join(sized, "path").write.parquet(where)
        level = spark.read.parquet(where)
        last = depth == DEPTH - 1
        leaves = level if last else level.where(F.col("size") <= limit)
        buckets = leaves if buckets is None else buckets.unionAll(leaves)
        if last or not level.where(F.col("size") > limit).head(1):
            break
        if depth == 0:  # by node, a bit for each of its first-level buckets that is split
            where, extra = scratch_path(spark, "jaccard-split"), ["split"]
            (level.where(F.col("size") > limit).groupBy("node")
             .agg(F.bit_or(F.expr("shiftleft(1L, coord)")).alias("split")).write.parquet(where))
            known = nodes.join(spark.read.parquet(where), "node", "left").fillna(0, extra)
        big = level.where(F.col("size") > limit).join(nodes.select("node", "sketch"), "node")
        rows = split(big).distinct()
    member = buckets.join(known.select("node", "n", "sketch", "tokens", *extra), "node").select("path", "coord", "node", "n", "sketch", "tokens", *extra)

    # Buckets go to tasks in ranges of paths, so that a task call serves many small buckets.
    ranges = F.pmod(F.col("path"), F.lit(parts_for(docs))).alias("part")
    where = scratch_path(spark, "jaccard-candidates")
    (member.groupBy(ranges).applyInArrow(lambda got: _probe(got, order, threshold), paths).write.parquet(where))
    wanted = spark.read.parquet(where).groupBy("node").agg(F.collect_list(F.struct("path", "coord")).alias("paths"))
    wanted = wanted.join(known, "node").select("key", "node", "n", "copies", "sketch", "tokens", "paths", *extra)

    full = T.StructType([T.StructField("path", T.LongType()), T.StructField("coord", T.IntegerType()), T.StructField("node", T.LongType()),
                         T.StructField("n", T.IntegerType()), T.StructField("copies", T.IntegerType()),
                         T.StructField("sketch", T.BinaryType()), T.StructField("tokens", T.BinaryType()), T.StructField("grams", T.BinaryType()),
                         *[T.StructField(x, T.LongType()) for x in extra]])

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {x: batch.column(x).to_pylist() for x in ("node", "n", "copies", "sketch", "tokens", "paths", *extra)}
            seen = set()
            for i, j, h, bounds in gram_sets(batch.column(batch.schema.get_field_index("text")), gram):
                out = []
                for t in range(i, j):
                    if col["node"][t] in seen:  # a repeated row
                        continue
                    seen.add(col["node"][t])
                    grams = h[bounds[t - i] : bounds[t - i + 1]].tobytes()
                    out += [(p["path"], p["coord"], col["node"][t], col["n"][t], col["copies"][t], col["sketch"][t], col["tokens"][t], grams,
                             *[col[x][t] for x in extra])
                            for p in col["paths"][t]]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(
                    (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), *[pa.int64()] * len(extra)))],
                    names=full.names)

    texts = docs.select("key", "text").join(wanted, "key").select("text", "node", "n", "copies", "sketch", "tokens", "paths", *extra)
    where = scratch_path(spark, "jaccard-links")
    (arrow_map(texts, with_sets, full).groupBy(ranges).applyInArrow(lambda got: _verified(got, order, threshold), LINKS)
     .write.parquet(where))
    links = spark.read.parquet(where)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = []
            for others, copies in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                other, first = np.unique(np.frombuffer(b"".join(others), np.int64), return_index=True)
                total.append(int(np.frombuffer(b"".join(copies), np.int64)[first].sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64())], names=["node", "linked"])

    degree = arrow_map(links.groupBy("node").agg(F.collect_list("others").alias("others"), F.collect_list("copies").alias("copies")),
                       count, T.StructType([T.StructField("node", T.LongType()), T.StructField("linked", T.LongType())]))
    labels = components(links.select("node", "root"))
    named = labels.join(nodes.select("node", F.struct("doc_id", "key").alias("own")), "node")
    classes = named.join(named.groupBy("label").agg(F.min("own").alias("least")), "label").select("node", "least")
    by_node = (nodes.select("node", "copies", F.struct("doc_id", "key").alias("own")).join(classes, "node", "left").join(degree, "node", "left")
               .select("node", "copies", F.coalesce("least", "own").alias("least"), F.coalesce("linked", F.lit(0)).alias("linked"))
               .select("node", "copies", F.col("least.doc_id").alias("class_doc"), F.col("least.key").alias("class_key"), "linked"))
    own = F.col("doc_id").isNotNull()
    return (sketched.select("doc_id", "key", "node").join(by_node, "node", "left")
            .select("doc_id", "key", F.coalesce("class_key", "key").alias("class_key"), F.when(own, F.coalesce("class_doc", "doc_id")).alias("class_id"),
                    F.when(own, F.coalesce(F.col("linked") + F.col("copies") - 1, F.lit(0))).otherwise(0).cast("long").alias("n_links"),
                    F.when(own, F.coalesce("copies", F.lit(1))).otherwise(1).cast("long").alias("n_copies")))


def similar_documents(df: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of its class), n_links (other documents at the threshold
    or more, copies included), n_copies (documents with the same set, itself included).

    Options: id_col, text_col, gram, threshold, limit (buckets of more nodes are split).
    """
    return _classes(df, **options).select("doc_id", "class_id", "n_links", "n_copies")


def op1(documents: DataFrame) -> DataFrame:
    return similar_documents(documents)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class one row stays: that of the smallest id (of several such, that of the smallest hash of id and text)."""
    key = fresh("key", docs.columns)
    stay = (_classes(docs).where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("class_key")))
            .select("doc_id", F.col("key").alias(key)).distinct())
    names = docs.columns
    own = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    kept = docs.where(F.col("doc_id").isNotNull()).withColumn(key, own).join(stay, ["doc_id", key])
    once = kept.dropDuplicates(["doc_id", key]).select(*[F.col(f"`{c}`") for c in names])
    return once.unionByName(docs.where(F.col("doc_id").isNull()))
