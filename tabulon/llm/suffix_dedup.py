"""Suffix-array dedup with a difference cover, one block of suffix buckets at a time.

Wanted are the strings of LENGTH bytes that start at two places or more.  The suffixes that can start one are cut
into buckets that fit in memory: all with the same winnowed anchor (the 64-gram of least hash among their first LENGTH bytes)
and the same 130 bytes or so around it.  Only suffixes whose anchor occurs twice anywhere are sorted.  Within a
block of buckets, the positions of a difference cover (period 32) are ranked by their first 128 bytes; the suffixes
of a bucket are then sorted to depth LENGTH by three-way partitioning: short keys first, long ties by the cover ranks
at the offsets that two positions share, so that no comparison runs along the text.  Suffixes that stay equal mark
their bytes.

Equal stretches are settled at the first place that sees two of them (batch, then bucket), so a hot passage costs
one entry a batch.  Matches never cross documents; overlaps count; null texts are empty; rows without an id are
documents like others; repeated rows are copies.  Texts are handled whole, as UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.anchors import (PLACES, SETTLED, U32, _joined, packed_schema, passed_on, rows_to_batch, settle, settled_rows,
                                 shared_places, unpack, window_anchor)
from tabulon.llm.common import arrow_map, parts_for
from tabulon.llm.seed_extend import keyed
from tabulon.llm.words import mix, powers, text_blocks

LENGTH, GRAM = 200, 64
#: Offsets of an anchor in its suffix up to here share the bytes after it, larger ones the bytes before it.
NEAR = (LENGTH - GRAM) // 2
PERIOD, DEPTH = 32, 128
BLOCK = 1 << 20


@lru_cache(maxsize=1)
def difference_cover() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(residue is in the cover, first shared offset, second shared offset) by the residues of two positions.

    The cover is grown greedily until every difference modulo PERIOD occurs.  The first shared offset is the least;
    the second is the largest that still lets DEPTH bytes end within LENGTH.
    """
    cover = [0, 1]
    missing = lambda c: set(range(PERIOD)) - {(a - b) % PERIOD for a in c for b in c}
    while missing(cover):
        cover.append(min((x for x in range(PERIOD) if x not in cover), key=lambda x: len(missing([*cover, x]))))
    on = np.zeros(PERIOD, bool)
    on[cover] = True
    first, second = np.zeros((PERIOD, PERIOD), np.int64), np.zeros((PERIOD, PERIOD), np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            both = [d for d in range(LENGTH - DEPTH + 1) if on[(a + d) % PERIOD] and on[(b + d) % PERIOD]]
            first[a, b], second[a, b] = both[0], both[-1]
    assert first.max() < PERIOD and second.min() > LENGTH - DEPTH - PERIOD
    return on, first, second


def _prefix(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return total


def _span_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(total))
    return mix((total[end] - total[start]) * down[start])


def _anchored(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor position, first start, last start, text) of the suffixes of each anchor, and the byte sums."""
    total = _prefix(data)
    n = len(data) - LENGTH + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z, z, total
    grams = _span_hash(total, np.arange(len(data) - GRAM + 1), np.arange(GRAM, len(data) + 1))
    at = window_anchor(grams, LENGTH - GRAM + 1)
    size = np.diff(bounds)
    text = np.flatnonzero(size >= LENGTH)
    count = size[text] - LENGTH + 1
    start = np.repeat(bounds[text] - np.cumsum(count) + count, count) + np.arange(count.sum())
    of = np.repeat(text, count)
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z, z, z, total
    at = at[start]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (of[1:] != of[:-1])]))
    last = np.concatenate([new[1:], [len(start)]]) - 1
    return at[new], start[new], start[last], of[new], total


def anchors_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, byte position) of the anchors of a batch of texts."""
    out = []
    for i, _, data, bounds in text_blocks(texts, BLOCK):
        at, _, _, of, total = _anchored(data, bounds)
        if len(at):
            out.append((_span_hash(total, at, at + GRAM), of + i, at - bounds[of]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


STRETCHES = packed_schema("buckets", "wholes", "keys", "starts", "sizes", "fronts", "bytes")


def _runs(keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, (start, end)) of the byte runs by key, touching runs joined."""
    if not len(keys):
        return keys, np.zeros((0, 2), np.int64)
    order = np.lexsort((end, start, keys))
    keys, start, end = keys[order], start[order], end[order]
    group = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]]))
    lift = group * (1 << 33)  # texts apart, so that one running maximum serves all
    reach = np.maximum.accumulate(end + lift)
    new = np.flatnonzero(np.concatenate([[True], (start + lift)[1:] > reach[:-1]]))
    last = np.concatenate([new[1:], [len(keys)]]) - 1
    return keys[new], np.stack([start[new], reach[last] - lift[new]], axis=1)


def stretches(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """(owner, key, text, places) -> the bytes of the suffixes at shared anchors, by bucket; equal ones of a batch once."""
    for batch in batches:
        key = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        places = [np.frombuffer(x, U32) for x in batch.column(3).to_pylist()]
        for i, j, data, bounds in text_blocks(batch.column(2), 2 * BLOCK):
            at, first, last, of, total = _anchored(data, bounds)
            if not len(at):
                continue
            shared = np.zeros(len(data), bool)
            for t in range(i, j):
                shared[bounds[t - i] + places[t].astype(np.int64)] = True
            on = shared[at]
            at, first, last, of = at[on], first[on], last[on], of[on]
            # Suffixes near the anchor share the bytes after it, the others those before it.
            near, far = last >= at - NEAR, first < at - NEAR
            a1, f1 = at[near], np.maximum(first[near], at[near] - NEAR)
            a2, l2 = at[far], np.minimum(last[far], at[far] - NEAR - 1)
            side = mix(np.concatenate([_span_hash(total, a1, a1 + LENGTH - NEAR),
                                       _span_hash(total, a2 - NEAR - 1, a2 + GRAM) + np.uint64(1)]))
            start, stop = np.concatenate([f1, first[far]]), np.concatenate([last[near], l2]) + LENGTH
            front = np.concatenate([a1 - f1, a2 - first[far]])
            row = np.concatenate([of[near], of[far]])
            if not len(start):
                continue
            whole = _span_hash(total, start, stop) ^ mix((stop - start).astype(np.uint64))
            order = np.lexsort((whole, front, side))
            side, start, stop, front, row, whole = (x[order] for x in (side, start, stop, front, row, whole))
            new = np.concatenate([[True], (side[1:] != side[:-1]) | (whole[1:] != whole[:-1]) | (front[1:] != front[:-1])])
            head = np.flatnonzero(new)
            many = np.diff([*head, len(side)]) > 1
            twice = np.repeat(many, np.diff([*head, len(side)]))
            keys, base = key[row + i], bounds[row]
            rows = settled_rows(STRETCHES, settle(parts, *_runs(keys[twice], (start - base)[twice], (stop - base)[twice])))
            part = (side[head] >> np.uint64(32)) % np.uint64(parts)
            for p in np.unique(part):
                h = head[part == p]
                rows.append((int(p), side[h].tobytes(), whole[h].tobytes(), keys[h].tobytes(), (start - base)[h].astype(U32).tobytes(),
                             (stop - start)[h].astype(U32).tobytes(), front[h].astype(np.uint16).tobytes(),
                             b"".join(data[a:b].tobytes() for a, b in zip(start[h], stop[h], strict=True)),
                             None, None, None))
            yield rows_to_batch(STRETCHES, rows)


def equal_suffixes(text: np.ndarray, position: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Whether another suffix of the same bucket has the same first LENGTH bytes.

    `text` has LENGTH bytes after each position.
    """
    on, first, second = difference_cover()
    n = len(text)
    padded = np.concatenate([text, np.zeros(LENGTH + DEPTH, np.uint8)])
    eight = np.zeros(n + LENGTH, np.uint64)
    for k in range(8):
        eight = (eight << np.uint64(8)) | padded[k : k + n + LENGTH].astype(np.uint64)
    # Ranks of the cover positions by 32, 64 and 128 bytes.
    cover = np.flatnonzero(np.tile(on, n // PERIOD + 1)[:n])
    order = np.lexsort([eight[cover + k] for k in (24, 16, 8, 0)])
    differ = np.zeros(len(cover), bool)
    for k in (0, 8, 16, 24):
        x = eight[cover[order] + k]
        differ[1:] |= x[1:] != x[:-1]
    rank = np.zeros(n + DEPTH, np.int64)
    rank[cover[order]] = np.cumsum(differ) + 1
    for width in (32, 64):
        pair = rank[cover] * (len(cover) + 2) + rank[cover + width]
        _, inverse = np.unique(pair, return_inverse=True)
        rank[cover] = inverse + 1
    twice = np.zeros(len(position), bool)
    order = np.argsort(bucket, kind="stable")
    idx, group = order, bucket[order]
    while len(idx):
        new = np.concatenate([[True], group[1:] != group[:-1]])
        size = np.diff([*np.flatnonzero(new), len(group)])
        live = np.repeat(size > 1, size)
        idx = idx[live]
        if not len(idx):
            break
        size = size[size > 1]
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        pivot = np.repeat(idx[start + size // 2], size)
        group = np.repeat(np.arange(len(size)), size)
        a, b = position[idx], position[pivot]
        sign = np.zeros(len(idx), np.int8)
        open_ = np.flatnonzero(a != b)

        def settle(x: np.ndarray, y: np.ndarray, open_=open_, sign=sign) -> np.ndarray:
            sign[open_] = (x > y).astype(np.int8) - (x < y).astype(np.int8)
            return open_[x == y]

        for k in (0, 8, 16, 24):
            open_ = settle(eight[a[open_] + k], eight[b[open_] + k], open_)
        for offset in (first, second):
            d = offset[a[open_] % PERIOD, b[open_] % PERIOD]
            open_ = settle(rank[a[open_] + d], rank[b[open_] + d], open_)
        for k in range(LENGTH - 32, LENGTH, 8):
            open_ = settle(eight[a[open_] + k], eight[b[open_] + k], open_)
        same = sign == 0
        many = np.bincount(group[same], minlength=len(size))
        twice[idx[same]] = many[group[same]] > 1
        rest = ~same
        order = np.lexsort((sign[rest], group[rest]))
        idx, group = idx[rest][order], (group[rest] * 2 + (sign[rest] > 0))[order]
    return twice


def resolve(got: pa.Table, parts: int) -> pa.Table:
    """The byte runs of the repeated bytes in the stretches of one range of buckets."""
    packed, out = got.filter(pc.is_null(got["of_keys"])), passed_on(got)
    side = _joined(packed["buckets"], np.uint64)
    if len(side):
        keys, first = _joined(packed["keys"], np.int64), _joined(packed["starts"], U32).astype(np.int64)
        size, front = _joined(packed["sizes"], U32).astype(np.int64), _joined(packed["fronts"], np.uint16).astype(np.int64)
        data = _joined(packed["bytes"], np.uint8)
        place = np.cumsum(size) - size
        whole = _joined(packed["wholes"], np.uint64)
        order = np.lexsort((whole, front, side))
        s, w, f = side[order], whole[order], front[order]
        new = np.concatenate([[True], (s[1:] != s[:-1]) | (w[1:] != w[:-1]) | (f[1:] != f[:-1])])
        count = np.diff([*np.flatnonzero(new), len(s)])
        at = order[np.repeat(count > 1, count)]
        marked = [(keys[at], first[at], first[at] + size[at])]
        # One of each set of equal stretches stands for them; buckets with two or more of those are sorted.
        one = order[new]
        bucket = np.cumsum(np.concatenate([[0], side[one][1:] != side[one][:-1]]))
        count = np.bincount(bucket)
        keep = count[bucket] > 1
        one, bucket = one[keep], bucket[keep]
        if len(one):
            of = np.cumsum(new) - 1
            member = np.argsort(of, kind="stable")
            head = np.searchsorted(of, np.arange(of[-1] + 1))
            tail = np.concatenate([head[1:], [len(of)]])
            number = np.flatnonzero(new).searchsorted(np.flatnonzero(new)[keep])
            cum = np.cumsum(size[one])
            i = 0
            while i < len(one):
                j = int(np.searchsorted(cum, (cum[i - 1] if i else 0) + BLOCK, side="right"))
                j = max(j, i + 1)
                while j < len(one) and bucket[j] == bucket[j - 1]:  # a bucket stays together
                    j += 1
                pick = one[i:j]
                length = size[pick]
                begin = np.cumsum(length) - length
                index = np.repeat(place[pick] - begin, length) + np.arange(length.sum())
                text = data[index]
                n_start = length - LENGTH + 1
                which = np.repeat(np.arange(len(pick)), n_start)
                step = np.arange(n_start.sum()) - np.repeat(np.cumsum(n_start) - n_start, n_start)
                # Equal suffixes have their anchor at the same offset.
                name = bucket[i:j][which] * (LENGTH + 1) + (front[pick][which] - step)
                _, name = np.unique(name, return_inverse=True)
                hit = equal_suffixes(text, begin[which] + step, name)
                which, step = which[hit], step[hit]
                for k in np.unique(which):
                    mine = step[which == k]
                    g = number[i + k]
                    for m in order[member[head[g] : tail[g]]]:
                        marked.append((np.full(len(mine), keys[m]), first[m] + mine, first[m] + mine + LENGTH))
                i = j
        out += settle(parts, *_runs(*(np.concatenate(x) for x in zip(*marked, strict=True))))
    return pa.Table.from_batches([rows_to_batch(SETTLED, out)])


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """(key, places): the byte runs of each row of (owner, key, text) that LENGTH-byte repeats cover."""
    parts = parts_for(docs, 4 << 20)
    docs = docs.select("owner", "key", "text")
    whole = docs.where(F.octet_length("text") >= LENGTH).select(F.lit(0).cast("long").alias("owner"), "key", "text")
    shared = shared_places(whole, parts, anchors_of, same_document_counts=True)
    # The same columns as the final join takes, so that Spark shuffles the texts once for both.
    near = docs.join(shared, "key").select("owner", "key", "text", "places")
    packed = arrow_map(near, lambda b: stretches(b, parts), STRETCHES)
    found = packed.groupBy("part").applyInArrow(lambda got: resolve(got, parts), SETTLED)
    return found.groupBy("part").applyInArrow(unpack(2), PLACES)


KEPT = T.StructType([T.StructField("owner", T.LongType()), T.StructField("kept", T.BinaryType()),
                     *[T.StructField(x, T.LongType()) for x in ("n_bytes", "n_removed", "n_spans")]])


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(owner, kept, n_bytes, n_removed, n_spans): each row's bytes without the repeats (`digest`: their SHA-256)."""
    docs = keyed(df, id_col, text_col)
    joined = docs.join(repeated_bytes(docs), "key", "left").select("owner", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, removed, spans = [], [], [], []
            for text, places in zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
                raw = text.as_py() or b""
                parts, at, n = [], 0, 0
                if places:
                    runs = np.frombuffer(places, U32).reshape(-1, 2)
                    for a, b in runs[np.lexsort((runs[:, 1], runs[:, 0]))].tolist():
                        if a > at or not n:
                            parts.append(raw[at:a])
                            n += 1
                        at = max(at, b)
                parts.append(raw[at:])
                out = b"".join(parts)
                kept.append(hashlib.sha256(out).digest() if digest else out)
                total.append(len(raw))
                removed.append(len(raw) - len(out))
                spans.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()),
                                              *[pa.array(x, pa.int64()) for x in (total, removed, spans)]], names=KEPT.names)

    return arrow_map(joined, run, KEPT)


def op6(documents: DataFrame) -> DataFrame:
    return remove_repeats(documents, digest=True).select(
        F.col("owner").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))
