"""Substring dedup by seed and extend.

Seeds are winnowed anchors: the word 5-gram of least hash in each window.  Documents are joined on the anchors that
documents with different ids share; around each shared anchor the match is extended both ways to all windows of
WINDOW words that have it as their anchor, and for each such window the smallest document id that holds the same
words is found.  A word goes if a window that covers it also starts in a document with a smaller id: the windows
together are the maximal repeats of at least WINDOW words.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged.  Windows are told apart by 96 bits of hash.  Null texts have no words;
rows without an id keep all words and take none from others; repeated rows are treated alike.  Texts are handled
whole.  Shuffled are anchors (14 bytes each, packed), the windows at shared anchors, and the texts once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.anchors import (PLACES, SETTLED, U16, U32, _joined, packed_schema, passed_on, rows_to_batch, settle,
                                 settled_rows, shared_places, sorted_places, unpack, window_anchor)
from tabulon.llm.common import arrow_map, parts_for
from tabulon.llm.words import SPACE, Words, byte_table, mix, shingle_hashes, text_blocks

WINDOW, SEED = 13, 5
_TABLES = byte_table(drop=SPACE)


def _windows(words: Words, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, anchor position, text) of every window inside a text, and the seed hashes."""
    n = len(words.hash) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text = words.text_of_word()
    seeds = shingle_hashes(words.hash, seed)
    at = window_anchor(seeds, window - seed + 1)
    start = np.flatnonzero(text[:n] == text[window - 1 :])
    return start, at[start], text[start], seeds


def anchors_of(texts: pa.Array, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, word position) of the anchors of a batch of texts."""
    out = []
    for i, _, data, bounds in text_blocks(texts):
        words = Words(data, bounds, _TABLES)
        _, at, text, seeds = _windows(words, window, seed)
        if len(at):
            new = np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
            at, text = at[new], text[new]  # anchor positions never go back
            out.append((seeds[at], text + i, at - words.first[text]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


ENTRIES = packed_schema("hashes", "checks", "owners", "keys", "low", "high")


def _least_owner(order_by: tuple, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, group start, least owner) of entries grouped by the hash columns (primary last)."""
    order = np.lexsort((owner, *order_by))
    cols = [x[order] for x in order_by]
    new = np.concatenate([[True], np.logical_or.reduce([x[1:] != x[:-1] for x in cols])])
    start = np.flatnonzero(new)
    return order, start, np.repeat(owner[order][start], np.diff([*start, len(order)]))


def extend(batches: Iterator[pa.RecordBatch], parts: int, window: int, seed: int) -> Iterator[pa.RecordBatch]:
    """(owner, key, text, places) -> windows at shared anchors: decided where this batch can, else packed."""
    for batch in batches:
        owner = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        key = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        places = [np.frombuffer(x, U32) for x in batch.column(3).to_pylist()]
        got = []
        for i, j, data, bounds in text_blocks(batch.column(2)):
            words = Words(data, bounds, _TABLES)
            start, at, text, _ = _windows(words, window, seed)
            if not len(start):
                continue
            shared = np.zeros(len(words.hash), bool)
            for t in range(i, j):
                shared[words.first[t - i] + places[t]] = True
            on = shared[at]
            start, text = start[on], text[on]
            h = shingle_hashes(words.hash, window)[start]
            check = (shingle_hashes(mix(words.hash + np.uint64(1)), window)[start] >> np.uint64(32)).astype(U32)
            got.append((h, check, text + i, start - words.first[text]))
        if not got:
            continue
        h, check, row, place = (np.concatenate(x) for x in zip(*got, strict=True))
        if not len(h):
            continue
        order, _, least = _least_owner((check, h), owner[row])
        h, check, row, place = h[order], check[order], row[order], place[order]
        gone = owner[row] > least
        rows = settled_rows(ENTRIES, settle(parts, *sorted_places(key[row[gone]], place[gone])))
        h, check, row, place = h[~gone], check[~gone], row[~gone], place[~gone]
        part = (h >> np.uint64(32)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        part = part[order]
        for p in np.unique(part):
            at = order[np.searchsorted(part, p) : np.searchsorted(part, p, side="right")]
            rows.append((int(p), h[at].tobytes(), check[at].tobytes(), owner[row[at]].tobytes(), key[row[at]].tobytes(),
                         (place[at] & 0xFFFF).astype(U16).tobytes(), (place[at] >> 16).astype(U16).tobytes(),
                         None, None, None))
        yield rows_to_batch(ENTRIES, rows)


def resolve(got: pa.Table, parts: int) -> pa.Table:
    """The windows of one hash range that a document with a smaller id holds too."""
    packed, out = got.filter(pc.is_null(got["of_keys"])), passed_on(got)
    h = _joined(packed["hashes"], np.uint64)
    if len(h):
        check, owner, keys = _joined(packed["checks"], U32), _joined(packed["owners"], np.int64), _joined(packed["keys"], np.int64)
        places = _joined(packed["low"], U16).astype(np.int64) | (_joined(packed["high"], U16).astype(np.int64) << 16)
        order, _, least = _least_owner((check, h), owner)
        gone = owner[order] > least
        out += settle(parts, *sorted_places(keys[order][gone], places[order][gone]))
    return pa.Table.from_batches([rows_to_batch(SETTLED, out)])


def repeated_windows(docs: DataFrame, *, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(key, places): of each row of (owner, key, text), the windows that a row of a smaller owner holds too."""
    parts = parts_for(docs, 8 << 20)
    docs = docs.select("owner", "key", "text")
    shared = shared_places(docs.where(F.col("owner").isNotNull() & F.col("text").isNotNull()), parts,
                           lambda texts: anchors_of(texts, window, seed), same_document_counts=False)
    # The same columns as the final join takes, so that Spark shuffles the texts once for both.
    near = docs.join(shared, "key").select("owner", "key", "text", "places")
    packed = arrow_map(near, lambda b: extend(b, parts, window, seed), ENTRIES)
    found = packed.groupBy("part").applyInArrow(lambda got: resolve(got, parts), SETTLED)
    return found.groupBy("part").applyInArrow(unpack(1), PLACES)


KEPT = T.StructType([T.StructField("owner", T.LongType()), T.StructField("kept", T.BinaryType()),
                     T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(owner, key, text): the key is a hash of id and text, so equal rows share a key and a decision."""
    return df.select(F.col(id_col).cast("long").alias("owner"), F.col(text_col).cast("string").alias("text")).select(
        "owner", F.xxhash64("owner", "text").alias("key"), "text")


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   seed: int = SEED, digest: bool = False) -> DataFrame:
    """(owner, kept, n_words, n_removed): each row's words without the repeats, joined by one space.

    With `digest`, `kept` is the SHA-256 of those bytes.
    """
    docs = keyed(df, id_col, text_col)
    joined = docs.join(repeated_windows(docs, window=window, seed=seed), "key", "left").select("owner", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, removed = [], [], []
            texts = batch.column(1).cast(pa.binary())
            for text, places in zip(texts, batch.column(2).to_pylist(), strict=True):
                words = (text.as_py() or b"").split()
                total.append(len(words))
                if places:
                    mark = np.zeros(len(words) + 1, np.int32)
                    at = np.unique(np.frombuffer(places, U32)).astype(np.int64)
                    mark[at] += 1
                    np.subtract.at(mark, at + window, 1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(mark[:-1]) == 0)]
                removed.append(total[-1] - len(words))
                out = b" ".join(words)
                kept.append(hashlib.sha256(out).digest() if digest else out)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(total, pa.int64()),
                                              pa.array(removed, pa.int64())], names=KEPT.names)

    return arrow_map(joined, run, KEPT)


def op5(documents: DataFrame) -> DataFrame:
    return remove_repeats(documents, digest=True).select(
        F.col("owner").alias("doc_id"), "n_words", "n_removed", F.lower(F.hex("kept")).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
w AS (SELECT doc_id, s, array_to_string(words[s : s + 12], ' ') AS win
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS s FROM d WHERE len(words) >= 13)),
l AS (SELECT win, min(doc_id) AS least FROM w GROUP BY 1),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS pos FROM w JOIN l USING (win) WHERE doc_id > least),
p AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS pos, unnest(words) AS word FROM d),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n
      FROM p LEFT JOIN g USING (doc_id, pos) WHERE g.doc_id IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
