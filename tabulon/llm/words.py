"""Vectorised word splitting and hashing of Arrow text batches.

Texts of a batch are handled as one byte buffer in blocks of bounded size, so memory depends on the
block and the longest single text, not on the batch.  Hashes are 64 bit: a polynomial over the bytes
(odd base, modulo 2^64) finished by a bit mixer; null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Base powers and inverse powers 0..n-1 (n rounded up by the caller so the cache is reused)."""
    up = np.full(n, _BASE, np.uint64)
    up[0] = _ONE
    down = np.full(n, np.uint64(_inverse(int(_BASE))), np.uint64)
    down[0] = _ONE
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(10, int(n).bit_length()))


def byte_table(word: bytes | range | None = None, *, drop: bytes = b"", lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(is word byte, byte map): every byte not in `drop` is part of a word; `lower` maps A-Z."""
    keep = np.ones(256, bool)
    keep[np.frombuffer(drop, np.uint8)] = False
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    return keep, table


#: Words of `[^\x20\x09-\x0D]+`: separators are space, tab, line feed, vertical tab, form feed and return.
SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: Separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z.
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


class Words:
    """The words of several texts: byte ranges, text number and 64-bit hash of each word."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, tables: tuple[np.ndarray, np.ndarray]):
        """`data`: bytes of the texts one after another; `bounds`: n+1 offsets into it."""
        keep, table = tables
        self.data, self.bounds = data, bounds
        inside = keep[data]
        edge = np.empty(len(data) + 1, bool)
        edge[0] = len(data) > 0 and inside[0]
        edge[-1] = len(data) > 0 and inside[-1]
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        # A word also ends where its text ends.
        cut = bounds[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        cut = np.unique(cut[inside[cut - 1] & inside[cut]]) if len(cut) else cut
        at = np.flatnonzero(edge)
        if len(cut):
            at = np.sort(np.concatenate([at, cut, cut]))
        self.start, self.end = at[0::2], at[1::2]
        #: first word of each text, and one past the last
        self.first = np.searchsorted(self.start, bounds[:-1], side="left")
        self.last = np.searchsorted(self.start, bounds[1:], side="left")
        up, down = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((table[data].astype(np.uint64) + _ONE) * up[: len(data)], out=total[1:])
        span = total[self.end] - total[self.start]
        self.hash = mix(span * down[self.start] + (self.end - self.start).astype(np.uint64))

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first)), self.last - self.first)


def shingle_hashes(word_hash: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k consecutive words from each position (texts are not told apart here)."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(word_hash) + 1)
    total = np.zeros(len(word_hash) + 1, np.uint64)
    np.cumsum(word_hash * up[: len(word_hash)], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[:n])


def text_blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, offsets) for runs of rows with about `limit` bytes; a longer text is a run of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_large_string(texts.type) or pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
    else:
        texts = texts.cast(pa.large_binary())
    n = len(texts)
    if n == 0:
        return
    if texts.null_count:
        texts = texts.fill_null(pa.scalar("" if pa.types.is_large_string(texts.type) else b"", texts.type))
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j
