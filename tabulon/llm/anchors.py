"""Winnowed anchors, and the packed shuffle that finds which of them several documents share.

An anchor is the k-gram with the smallest hash (the rightmost of equals) among the k-grams of a window, so two equal
windows have the same anchor at the same place.  Only anchors travel: packed arrays by hash range, one row for each
range and batch.  What a batch can decide on its own is decided there: an anchor that it holds several times is
known as shared and goes on as one entry, so an anchor that a third of all documents hold costs one entry a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tabulon.llm.common import arrow_map

U32, U16 = np.uint32, np.uint16


def packed_schema(*columns: str) -> T.StructType:
    """A range and packed columns; the last three carry places that are settled, by range of their keys."""
    return T.StructType([T.StructField("part", T.IntegerType()), *[T.StructField(x, T.BinaryType()) for x in columns],
                         *[T.StructField(x, T.BinaryType()) for x in ("of_keys", "of_sizes", "of_places")]])


PACKED = packed_schema("hashes", "keys", "low", "high", "known")
SETTLED = packed_schema()
PLACES = T.StructType([T.StructField("key", T.LongType()), T.StructField("places", T.BinaryType())])


def window_anchor(hashes: np.ndarray, span: int) -> np.ndarray:
    """Of each run of `span` hashes, the position of the smallest (rightmost of equals).

    Smallest by blocks of doubling length: two overlapping blocks make up a run.
    """
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if span <= 12:
        seen = sliding_window_view(hashes, span)
        return span - 1 - np.argmin(seen[:, ::-1], axis=1) + np.arange(n)
    at, value, width = np.arange(len(hashes)), hashes, 1
    while 2 * width <= span:
        a, b = value[:-width], value[width:]
        right = b <= a
        at, value = np.where(right, at[width:], at[:-width]), np.where(right, b, a)
        width *= 2
    a, b = value[:n], value[span - width : span - width + n]
    right = b <= a
    return np.where(right, at[span - width : span - width + n], at[:n])


def settle(parts: int, keys: np.ndarray, places: np.ndarray) -> list[tuple]:
    """(range of the keys, keys, sizes, places) for places (numbers or pairs) sorted by key."""
    if not len(keys):
        return []
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff([*new, len(keys)])
    part = keys[new] % parts
    out = []
    for p in np.unique(part):
        on = part == p
        out.append((int(p), keys[new[on]].tobytes(), size[on].astype(U32).tobytes(),
                    places[np.repeat(on, size)].astype(U32).tobytes()))
    return out


def sorted_places(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((places, keys))
    return keys[order], places[order]


def rows_to_batch(schema: T.StructType, rows: list[tuple]) -> pa.RecordBatch:
    """Rows of a packed schema; short rows are filled with nulls up to the settled columns."""
    n = len(schema.fields)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if i == 0 else pa.binary()) for i in range(n)],
                                      names=schema.names)


def settled_rows(schema: T.StructType, rows: list[tuple]) -> list[tuple]:
    return [(r[0], *[None] * (len(schema.fields) - 4), *r[1:]) for r in rows]


def passed_on(got: pa.Table) -> list[tuple]:
    """The settled rows among those of a range."""
    done = got.filter(pc.is_valid(got["of_keys"]))
    return list(zip(*[done[x].to_pylist() for x in SETTLED.names], strict=True))


def unpack(width: int) -> Callable[[pa.Table], pa.Table]:
    """One row for each key of a range, with all its places (`width` numbers each)."""

    def run(got: pa.Table) -> pa.Table:
        keys, size, places = _joined(got["of_keys"], np.int64), _joined(got["of_sizes"], U32).astype(np.int64), _joined(got["of_places"], U32)
        places = places.reshape(-1, width)
        start = np.cumsum(size) - size
        order = np.argsort(keys, kind="stable")
        keys, size, start = keys[order], size[order], start[order]
        places = places[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())]
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        cut = np.concatenate([[0], np.cumsum(size)])[np.concatenate([new, [len(keys)]])] if len(keys) else [0]
        return pa.table({"key": pa.array(keys[new], pa.int64()),
                         "places": pa.array([places[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})

    return run


def pack(parts: int, hashes: np.ndarray, keys: np.ndarray, places: np.ndarray, known: np.ndarray,
         known_keys: np.ndarray, known_places: np.ndarray) -> pa.RecordBatch:
    """One row for each hash range with its entries and the hashes known as shared, and the places settled here."""
    part, known_part = (hashes >> np.uint64(32)) % np.uint64(parts), (known >> np.uint64(32)) % np.uint64(parts)
    order, known_order = np.argsort(part, kind="stable"), np.argsort(known_part, kind="stable")
    part, known_part = part[order], known_part[known_order]
    rows = settled_rows(PACKED, settle(parts, *sorted_places(known_keys, known_places)))
    for p in np.union1d(part, known_part):
        at = order[np.searchsorted(part, p) : np.searchsorted(part, p, side="right")]
        kn = known_order[np.searchsorted(known_part, p) : np.searchsorted(known_part, p, side="right")]
        rows.append((int(p), hashes[at].astype(U32).tobytes(), keys[at].tobytes(),
                     (places[at] & 0xFFFF).astype(U16).tobytes(), (places[at] >> 16).astype(U16).tobytes(),
                     known[kn].astype(U32).tobytes(), None, None, None))
    return rows_to_batch(PACKED, rows)


def _joined(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), dtype)


def resolve_shared(got: pa.Table, every: bool, parts: int) -> pa.Table:
    """The entries of one hash range whose hash several keys hold (`every`: that occurs twice), or that some batch
    knows as shared."""
    packed = got.filter(pc.is_null(got["of_keys"]))
    h, keys = _joined(packed["hashes"], U32), _joined(packed["keys"], np.int64)
    places = _joined(packed["low"], U16).astype(np.int64) | (_joined(packed["high"], U16).astype(np.int64) << 16)
    known = np.unique(_joined(got["known"], U32))
    order = np.lexsort((keys, h))
    h, keys, places = h[order], keys[order], places[order]
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
    end = np.concatenate([start[1:], [len(h)]]).astype(int) if len(h) else start
    shared = (end - start > 1 if every else keys[start] != keys[end - 1]) if len(h) else np.zeros(0, bool)
    if len(known) and len(h):
        shared |= known[np.minimum(np.searchsorted(known, h[start]), len(known) - 1)] == h[start]
    on = np.repeat(shared, end - start)
    return pa.Table.from_batches([rows_to_batch(SETTLED, [*passed_on(got), *settle(parts, *sorted_places(keys[on], places[on]))])])


def shared_places(docs: DataFrame, parts: int,
                  anchors_of: Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]],
                  same_document_counts: bool) -> DataFrame:
    """(key, places): of each row of (owner, key, text), the anchors that others hold too.

    `anchors_of(texts)` gives (hash, row, place) of every anchor of a batch.  An anchor is shared if rows of different
    owners hold it, or, where `same_document_counts`, if it occurs twice anywhere.  The result may hold a few more
    (hashes are cut to the range and 32 bits), never fewer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            key = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            h, row, place = anchors_of(batch.column(2))
            who = row if same_document_counts else owner[row]
            order = np.lexsort((who, h))
            h, row, place, who = h[order], row[order], place[order], who[order]
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
            end = np.concatenate([start[1:], [len(h)]]).astype(int) if len(h) else start
            shared = (end - start > 1) if same_document_counts else (who[start] != who[end - 1] if len(h) else np.zeros(0, bool))
            on = np.repeat(shared, end - start)
            if len(h):
                yield pack(parts, h[~on], key[row[~on]], place[~on], h[start[shared]], key[row[on]], place[on])

    packed = arrow_map(docs, run, PACKED)
    found = packed.groupBy("part").applyInArrow(lambda got: resolve_shared(got, same_document_counts, parts), SETTLED)
    return found.groupBy("part").applyInArrow(unpack(1), PLACES)
