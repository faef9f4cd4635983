"""Benchmark decontamination with Wu-Manber multi-pattern search over words.

The patterns are the windows of `width` consecutive words of every benchmark item (an item of fewer words is one
window).  For patterns of one length m, a shift table over blocks of two words says how far a cursor can move
without missing an occurrence; where it says zero, the hash of the last block selects a bucket of patterns, and
comparing the bytes of the words confirms.  Cursors of many stretches of text move at once.

The index is arrays only: the bytes and word bounds of the items, and for each different window one sorted key (the hash
of its last block, then that of the whole window), the place of one occurrence and the numbers of its items: about 6 bytes
for a byte of item text.  It is built and broadcast in shards of a checked size (SHARD_BYTES of item text, or one longer
item).  One map over the rows takes the shards up to STAGE_BYTES of index; where there are more, the rows are written by a
checkpoint and go through another map, so that a Python worker never holds more.  Null texts have no words, null items no windows; an item
without an id marks words but is not listed; repeated items count once; repeated documents get a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tabulon.llm.common import arrow_map, fresh, table
from tabulon.llm.words import NOT_ALNUM, Words, byte_table, mix, shingle_hashes, text_blocks
from tabulon.session import materialize

WIDTH = 10
SHARD_BYTES = 4 << 20
#: Bytes of index that a map holds (or one shard).
STAGE_BYTES = 256 << 20
STRETCH = 256
_TABLES = byte_table(drop=NOT_ALNUM, lower=True)
_SLOTS = 16
_C = np.uint64(0xD6E8FEB86659FD93)


def _blocks(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the block of `size` words (one or two) that ends at each position."""
    return mix(words[at]) if size == 1 else mix(words[at - 1] * _C + words[at])


def _same(a: tuple, at: np.ndarray, b: tuple, bt: np.ndarray, m: int) -> np.ndarray:
    """Whether the `m` words from each place of `a` are those from the place of `b`; both are (bytes, starts, ends)."""
    ok = np.ones(len(at), bool)
    for low in range(0, len(at), 1 << 14):
        for k in range(m):
            live = low + np.flatnonzero(ok[low : low + (1 << 14)])
            first = [x[1][y[live] + k].astype(np.int64) for x, y in ((a, at), (b, bt))]
            size, other = (x[2][y[live] + k] - f for x, y, f in ((a, at, first[0]), (b, bt, first[1])))
            ok[live] = size == other
            keep = size == other
            live, size, first = live[keep], size[keep], [f[keep] for f in first]
            if len(live):
                begin = np.cumsum(size) - size
                step = np.arange(size.sum()) - np.repeat(begin, size)
                x, y = (_TABLES[1][t[0][np.repeat(f, size) + step]] for t, f in ((a, first[0]), (b, first[1])))
                ok[live] = ~np.logical_or.reduceat(x != y, begin)
    return ok


def _keys(hashes: np.ndarray, at: np.ndarray, m: int, whole: np.ndarray) -> np.ndarray:
    """Key of the window of `m` words at each place: half of its last block's hash, half of its own."""
    last = _blocks(hashes, at + m - 1, min(2, m))
    return (last & np.uint64(0xFFFFFFFF00000000)) | (whole[at] >> np.uint64(32))


class Patterns:
    """All different windows of one length: their keys in order, a place each, and their items."""

    def __init__(self, words: tuple, hashes: np.ndarray, at: np.ndarray, item: np.ndarray, m: int):
        """`at`: places of all windows in the shard's words; `item`: number of each window's item, -1 without an id."""
        self.length, self.block = m, min(2, m)
        self.shift = np.full(1 << _SLOTS, m - self.block + 1, np.int64)
        for j in range(self.block - 1, m):
            slot = _blocks(hashes, at + j, self.block) >> np.uint64(64 - _SLOTS)
            np.minimum.at(self.shift, slot.astype(np.int64), m - 1 - j)
        key = _keys(hashes, at, m, shingle_hashes(hashes, m))
        order = np.argsort(key, kind="stable")
        keys, places, window = [], [], np.zeros(len(at), np.int64)
        while len(order):  # windows of one key that differ, if any, take another turn
            k = key[order]
            new = np.concatenate([[True], k[1:] != k[:-1]])
            number = np.cumsum(new) - 1
            lead = order[new]
            same = new.copy()
            same[~new] = _same(words, at[order[~new]], words, at[lead][number[~new]], m)
            window[order[same]] = number[same] + sum(map(len, keys))
            keys.append(k[new])
            places.append(at[lead])
            order = order[~same]
        keys, places = np.concatenate(keys), np.concatenate(places)
        by_key = np.argsort(keys, kind="stable")
        place = np.empty(len(by_key), np.int64)
        place[by_key] = np.arange(len(by_key))
        self.key, self.at = keys[by_key], places[by_key].astype(np.uint32)
        known = item >= 0
        size = int(item.max(initial=0)) + 1
        owner, number = np.divmod(np.unique(place[window[known]] * size + item[known]), size)
        self.items = number.astype(np.uint32)
        self.fan = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(keys)))]).astype(np.uint32)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.shift, self.key, self.at, self.items, self.fan))

    def find(self, words: Words, first: np.ndarray, last: np.ndarray, held: tuple) -> tuple[np.ndarray, np.ndarray]:
        """(start word, window) of every occurrence inside the texts' word ranges."""
        m, b = self.length, self.block
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        spans = [(np.arange(x, y - m + 1, STRETCH), y) for x, y in zip(first, last, strict=True) if y - x >= m]
        if not spans:
            return none
        start = np.concatenate([s for s, _ in spans])
        stop = np.minimum(start + STRETCH, np.repeat([y - m + 1 for _, y in spans], [len(s) for s, _ in spans]))
        at, end = start + m - 1, stop + m - 1  # a cursor is where a window ends
        found = []
        while len(at):
            code = _blocks(words.hash, at, b)
            step = self.shift[(code >> np.uint64(64 - _SLOTS)).astype(np.int64)]
            found.append(at[step == 0] - m + 1)
            at = at + np.maximum(step, 1)
            live = at < end
            at, end = at[live], end[live]
        near = np.concatenate(found)
        if not len(near):
            return none
        key = _keys(words.hash, near, m, shingle_hashes(words.hash, m))
        low, high = np.searchsorted(self.key, key, side="left"), np.searchsorted(self.key, key, side="right")
        near, k = np.repeat(near, high - low), np.repeat(low, high - low)
        k = k + np.arange(len(k)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        ok = _same((words.data, words.start, words.end), near, held, self.at[k].astype(np.int64), m)
        return near[ok], k[ok]


class Index:
    """The windows of a shard of items: the words of all items, the item ids, and Patterns by length."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        texts = pa.array([x for _, x in items], pa.string())
        data, start, end, hashes, of = [], [], [], [], []
        size = 0
        for i, _, raw, bounds in text_blocks(texts):
            words = Words(raw, bounds, _TABLES)
            data.append(_TABLES[1][raw])
            start.append((words.start + size).astype(np.uint32))
            end.append((words.end + size).astype(np.uint32))
            hashes.append(words.hash)
            of.append(words.text_of_word() + i)
            size += len(raw)
        none = [np.zeros(0, np.int64)]
        self.words = tuple(np.concatenate(x or none) for x in (data, start, end))
        hashes, of = np.concatenate(hashes or [np.zeros(0, np.uint64)]), np.concatenate(of or none)
        self.ids = sorted({x for x, _ in items if x is not None})
        name = {x: k for k, x in enumerate(self.ids)}
        number = np.array([name.get(x, -1) for x, _ in items], np.int64)
        count = np.bincount(of, minlength=len(items))
        length = np.minimum(count, width)[of]  # of each word's item
        left = (np.cumsum(count))[of] - np.arange(len(of))  # words from here to the end of the item
        self.patterns = [Patterns(self.words, hashes, at, number[of[at]], int(m))
                         for m in np.unique(length) for at in [np.flatnonzero((length == m) & (left >= m))]]

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (*self.words, *self.patterns))


def scan(texts: pa.Array, shards: list[Index]) -> tuple[np.ndarray, list[list[int]], list[list[str]]]:
    """Of each text: number of words, marked word runs (start, end, start, ...), items found."""
    n_words = np.zeros(len(texts), np.int64)
    runs: list[list[int]] = [[] for _ in range(len(texts))]
    items: list[list[str]] = [[] for _ in range(len(texts))]
    for i, j, data, bounds in text_blocks(texts):
        words = Words(data, bounds, _TABLES)
        n_words[i:j] = words.last - words.first
        mark = np.zeros(len(words.hash) + 1, np.int32)
        for index, group in [(x, g) for x in shards for g in x.patterns]:
            start, window = group.find(words, words.first, words.last, index.words)
            if len(start):
                np.add.at(mark, start, 1)
                np.add.at(mark, start + group.length, -1)
                text = np.searchsorted(words.last, start, side="right")
                size = len(group.key)
                for t, k in zip(*[x.tolist() for x in np.divmod(np.unique(text * size + window), size)], strict=True):
                    items[i + t].extend(index.ids[x] for x in group.items[group.fan[k] : group.fan[k + 1]].tolist())
        on = np.cumsum(mark[:-1]) > 0
        if on.any():
            for t in np.unique(np.searchsorted(words.last, np.flatnonzero(on), side="right")).tolist():
                here = np.concatenate([[False], on[words.first[t] : words.last[t]], [False]])
                runs[i + t] = np.flatnonzero(here[1:] != here[:-1]).tolist()
    return n_words, runs, [sorted(set(x)) for x in items]


def _joined(a: list[int], b: list[int]) -> list[int]:
    """Union of two run lists."""
    out: list[int] = []
    for s, e in sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)]):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def mark_contaminated(df: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", width: int = WIDTH,
                      shard_bytes: int = SHARD_BYTES, stage_bytes: int = STAGE_BYTES) -> tuple[DataFrame, dict[str, str]]:
    """The rows with n_words, hit_runs (word runs) and items appended; returns the frame and their names."""
    spark = df.sparkSession
    bench = benchmark.select(F.col(item_col).cast("string").alias("item"),
                             F.col(item_text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    total = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_bytes))
    names: dict[str, str] = {}
    for x in ("n_words", "hit_runs", "items"):
        names[x] = fresh(x, [*df.columns, *names.values()])
    fields = [T.StructField(names["n_words"], T.LongType()), T.StructField(names["hit_runs"], T.ArrayType(T.IntegerType())),
              T.StructField(names["items"], T.ArrayType(T.StringType()))]
    schema = T.StructType([*df.schema.fields, *fields])
    arrow, at, width_in = to_arrow_schema(schema), df.columns.index(text_col), len(df.columns)

    def marked(rows: DataFrame, shards: list[Broadcast]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, runs, items = scan(batch.column(at), [x.value for x in shards])
                if batch.num_columns > width_in:  # what earlier shards found
                    runs = [_joined(a, b) for a, b in zip(batch.column(width_in + 1).to_pylist(), runs, strict=True)]
                    items = [sorted({*a, *b}) for a, b in zip(batch.column(width_in + 2).to_pylist(), items, strict=True)]
                new = [pa.array(v, f.type) for v, f in zip((n, runs, items), list(arrow)[width_in:], strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width_in], *new], names=arrow.names)

        return arrow_map(rows, run, schema)

    out, held, size = df, [], 0
    for k in range(shards):
        part = bench if shards == 1 else bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == k)
        index = Index([(r["item"], r["text"]) for r in part.toLocalIterator()], width)
        if held and size + index.nbytes > stage_bytes:
            out, held, size = materialize(marked(out, held)), [], 0
        held.append(spark.sparkContext.broadcast(index))
        size += index.nbytes
    return marked(out, held), names


def hit_words(runs: str):
    """Number of words in a run list."""
    return F.aggregate(F.col(runs), F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("sign")),
                       lambda s, x: F.struct((s["n"] + s["sign"] * x).alias("n"), (-s["sign"]).alias("sign")),
                       lambda s: s["n"])


def op7(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    out, _ = mark_contaminated(docs, benchmark)
    hit = hit_words("hit_runs")
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                      (F.size("hit_runs") > 0).alias("contaminated"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    out, names = mark_contaminated(docs, table(spark, sf_dir, "benchmark"))
    return out.where(F.size(names["hit_runs"]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = r"""
WITH w AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT item_id, words, least(len(words), 10) AS m FROM w WHERE len(words) > 0),
p AS (SELECT DISTINCT item_id, m, array_to_string(words[s : s + m - 1], ' ') AS win
      FROM (SELECT item_id, words, m, unnest(range(1, len(words) - m + 2)) AS s FROM i)),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM documents),
o AS (SELECT doc_id, m, s, array_to_string(words[s : s + m - 1], ' ') AS win
      FROM (SELECT doc_id, words, m, unnest(range(1, len(words) - m + 2)) AS s
            FROM d, (SELECT DISTINCT m FROM p) WHERE len(words) >= m)),
f AS (SELECT o.doc_id, o.m, o.s, p.item_id FROM o JOIN p ON o.m = p.m AND o.win = p.win),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS pos FROM f) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM f) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(n.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""
