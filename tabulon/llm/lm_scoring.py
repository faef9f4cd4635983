"""LM scoring with an Elias-Fano n-gram trie of any order.

The model interpolates absolutely discounted n-grams (`order` words, three unless said otherwise) with add-one unigrams; it
learns from the rows that `train` selects.  Texts are dealt into blocks of bounded size by a hash of the row.  Texts and the
arrays that blocks and shards send each other travel compressed.  A block
sends its distinct words and n-grams with their training counts to the shard of the last context word.  A shard sums the
counts of all blocks and builds its part of the trie.  The first level holds the words; for each length of context there
is a level of contexts (the shorter context, then the word before it) and a level of successors (the context, then the
word: by hash after one word, by its rank among the successors of the shorter context after more).  Every level is one
monotone sequence in Elias-Fano form: high bits in unary with a count every 512 bits, low bits packed, both in mapped
files, with 16-bit quantised log probabilities and back-off weights beside them.  The n-grams that blocks ask for are sorted and
looked up in one pass over their level, a piece at a time, and answered in the order asked; the block then adds up its texts.

Words are told apart by 64 bits of hash, words next to a context by 40.  The most frequent training words (`FREQUENT`, a table of
fixed size) travel as their two-byte number instead.  Repetitions inside a block are added up
before the shuffle, so a frequent word or context costs a block one entry (and one for each distinct successor).  Null texts are
empty: one end token.  Rows without an id are scored too (their fold is that of the empty text); repeated rows count as often as they
occur.  With no training row, c, N and V are 0.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.anchors import _joined
from tabulon.llm.common import arrow_map, deliver, fold, parts_for
from tabulon.llm.words import SPACE, Words, byte_table, text_blocks

ORDER = 3
DISCOUNT = 0.75
#: log10 units of one quantisation step; code 0 means not seen.
STEP = 12 / 65535
#: Words that have a two-byte number, at most; the number after the last stands for any other word.
FREQUENT = (1 << 16) - 1
BEGIN, END = np.uint64(0x1B5E5BCD0F2A7C11), np.uint64(0x2E0D3F6A9C4B8813)
_TABLES = byte_table(drop=SPACE, lower=True)
_SHORT = np.uint64(24)  # 64 - 40
_ZSTD = pa.Codec("zstd", 1)
U8, U16, U32, U64 = np.uint8, np.uint16, np.uint32, np.uint64


def squeeze(raw: bytes) -> bytes:
    """A mark, then the bytes as they are, or their length and the bytes compressed where that is shorter."""
    if len(raw) >= 64:
        packed = _ZSTD.compress(raw, asbytes=True)
        if len(packed) + 8 < len(raw):
            return b"\1" + len(raw).to_bytes(8, "little") + packed
    return b"\0" + raw


def size_of(packed: bytes) -> int:
    return int.from_bytes(packed[1:9], "little") if packed[0] else len(packed) - 1


def expand(packed: bytes) -> bytes:
    return _ZSTD.decompress(packed[9:], size_of(packed), asbytes=True) if packed[0] else packed[1:]


def _texts(column: pa.ChunkedArray) -> pa.Array:
    return pa.array([None if x is None else expand(x) for x in column.to_pylist()], pa.large_binary())


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word, row) of every token; each text ends with END."""
    found = []
    for i, _, data, bounds in text_blocks(texts, 1 << 20):
        words = Words(data, bounds, _TABLES)
        n = words.last - words.first + 1
        row = np.repeat(np.arange(len(n)), n)
        word = np.full(len(row), END)
        is_end = np.zeros(len(row), bool)
        is_end[np.cumsum(n) - 1] = True
        word[~is_end] = words.hash
        found.append((word, (row + i).astype(np.int32)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _numbered(values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with return_inverse, of integers from 0 to under `limit`; by a sort of values that carry their place, where 64 bits hold both."""
    n = len(values)
    low = n.bit_length()
    if limit.bit_length() + low > 64 or low > 31:
        return np.unique(values, return_inverse=True)
    place = np.uint64(low)
    value = values.astype(U64)
    value <<= place
    value |= np.arange(n, dtype=U64)
    value.sort()
    at = (value & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int32)
    value >>= place
    new = _changes(value)
    value = value[new].view(np.int64)
    number = np.empty(n, np.int32)
    number[at] = np.cumsum(new, dtype=np.int32) - 1
    return value, number


def _changes(values: np.ndarray) -> np.ndarray:
    """True at the first of each run of equal values."""
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return new


def _starts(owner: np.ndarray, n: int) -> np.ndarray:
    """First place of each of n owners in a sorted array of owners, and its length at the end."""
    return np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


class Level:
    """The n-grams of one length of context in a block: contexts by shorter context, n-grams by context."""

    def __init__(self, parent: np.ndarray, word: np.ndarray, at: np.ndarray):
        self.parent, self.word, self.at = parent, word, at  # of each context: the shorter one, the word before it; of each token: its context

    def grams(self, key: np.ndarray, size: int, weight: np.ndarray) -> Level:
        """Distinct (context, key) pairs; `key` tells the tokens' n-grams apart and is under `size`."""
        contexts = int(self.at.max(initial=0)) + 1
        pair, number = _numbered(self.at.astype(np.int64) * size + key, contexts * size)
        self.pair = number.astype(np.int32)
        self.at = self.at.astype(np.int32)
        self.context, self.key = np.divmod(pair, size)
        self.first = _starts(self.context, contexts)
        self.count = np.bincount(number, weight, len(pair)).astype(np.int64)
        return self


class Block:
    """The distinct words and n-grams of a block of texts, ordered by shard, context and word (frequent words by number, then the others)."""

    def __init__(self, texts: pa.Array, trained: np.ndarray, parts: int, order: int, frequent: np.ndarray):
        word, self.row = tokens(texts)
        weight = trained[self.row].astype(np.float32)
        n = len(word)
        coded = pa.array(np.append(word, BEGIN)).dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False)
        del word
        near = numbers(words, frequent)
        by_number = np.lexsort((words, near))
        words, near, size = words[by_number], near[by_number], len(words)
        renamed = np.empty(size, np.int32)
        renamed[by_number] = np.arange(size)
        number = renamed[coded.indices.to_numpy()]  # in the order of the numbers and hashes
        del coded
        rank, begin = number[:n], number[-1]
        shard = (words >> np.uint64(16)) % np.uint64(parts)
        by_shard = np.argsort(shard, kind="stable")
        place = np.empty(size, np.int32)
        place[by_shard] = np.arange(size)
        self.words, self.numbers, self.shard = words[by_shard], near[by_shard], shard[by_shard].astype(np.int64)
        self.at = place[rank]  # token -> its word
        self.count = np.bincount(self.at, weight, size).astype(np.int64)
        self.short, self.near = words >> _SHORT, near
        in_text = np.arange(n, dtype=np.int32) - _starts(self.row, 0).astype(np.int32)[self.row]
        back = lambda k: np.where(in_text >= k, np.concatenate([np.full(k, begin, np.int32), rank])[:n], begin)
        level = Level(np.zeros(0, np.int64), np.zeros(0, np.int64), place[back(1)]).grams(rank, size, weight)
        self.levels = [level]
        for k in range(2, order):
            context, at = _numbered(level.at.astype(np.int64) * size + back(k), (int(level.at.max(initial=0)) + 1) * size)
            # An n-gram is named by the one after the shorter context, whose last words it shares.
            level = Level(*np.divmod(context, size), at).grams(level.pair, len(level.count), weight)
            self.levels.append(level)


def numbers(words: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Of each word its number among the frequent ones, or FREQUENT."""
    out = np.full(len(words), FREQUENT, U16)
    if len(frequent):
        order = np.argsort(frequent)
        known = frequent[order]
        at = np.minimum(np.searchsorted(known, words), len(known) - 1)
        same = known[at] == words
        out[same] = order[at[same]]
    return out


Columns = dict[str, np.dtype]


def _columns(order: int) -> tuple[Columns, Columns]:
    """The arrays that a block asks with, and that a shard answers with."""
    asks = {"numbers": U16, "words": U64, "counts": U32, "fans1": U32, "near1": U16, "low1": U32, "high1": U8, "grams1": U32}
    answers = {"counts": np.int64, "backoff1": U16, "codes1": U16}
    for k in range(2, order):
        asks |= {f"before{k}": U32, f"near{k}": U16, f"low{k}": U32, f"high{k}": U8, f"fans{k}": U32, f"ranks{k}": U32, f"grams{k}": U32}
        answers |= {f"backoff{k}": U16, f"codes{k}": U16}
    return tuple({x: np.dtype(y) for x, y in columns.items()} for columns in (asks, answers))


#: What a block and a shard send each other: arrays of hashes as they are, then the sizes of all arrays and the others squeezed.
CELL = T.StructType([*[T.StructField(x, T.IntegerType()) for x in ("shard", "block")],
                     *[T.StructField(x, T.BinaryType()) for x in ("hashes", "rest")]])


def _is_hash(column: str) -> bool:
    return column.startswith(("words", "low", "high"))


def _by_planes(column: str) -> bool:
    """The first bytes of all items, then the second ones and so on, as high bytes are mostly zero; codes often repeat whole."""
    return not column.startswith(("backoff", "codes"))


def cells(rows: list[tuple], columns: Columns) -> pa.Table:
    """A row of CELL for each (shard, block, arrays of the columns)."""
    hashes, rest = [], []
    for _, _, *arrays in rows:
        parts = [], [np.array([len(x) for x in arrays], U32).tobytes()]
        for (name, dtype), x in zip(columns.items(), arrays, strict=True):
            x = x.astype(dtype, copy=False)
            parts[0 if _is_hash(name) else 1].append((x.view(U8).reshape(-1, dtype.itemsize).T if _by_planes(name) else x).tobytes())
        hashes.append(b"".join(parts[0]))
        rest.append(squeeze(b"".join(parts[1])))
    keys = [pa.array([r[k] for r in rows], pa.int32()) for k in range(2)]
    return pa.Table.from_arrays([*keys, pa.array(hashes, pa.binary()), pa.array(rest, pa.binary())], names=CELL.names)


class Cells:
    """The arrays of several cells, one after another."""

    def __init__(self, got: pa.Table, columns: Columns):
        self.names, self.dtypes = list(columns), list(columns.values())
        self.raw = got["hashes"].to_pylist(), [expand(x) for x in got["rest"].to_pylist()]
        #: of each cell and column
        self.size = np.array([np.frombuffer(x, U32, len(columns)) for x in self.raw[1]], np.int64).reshape(-1, len(columns))
        length = self.size * [x.itemsize for x in self.dtypes]
        is_hash = np.array([_is_hash(x) for x in self.names])
        self.start = np.where(is_hash, np.cumsum(length * is_hash, 1), np.cumsum(length * ~is_hash, 1) + 4 * len(columns)) - length

    def take(self, name: str) -> np.ndarray:
        k = self.names.index(name)
        width = self.dtypes[k].itemsize
        sizes, starts, raw = self.size[:, k].tolist(), self.start[:, k].tolist(), self.raw[0 if _is_hash(name) else 1]
        if not _by_planes(name):
            return np.frombuffer(b"".join([x[i : i + n * width] for x, i, n in zip(raw, starts, sizes, strict=True)]), self.dtypes[k])
        out = np.empty((sum(sizes), width), U8)
        for w in range(width):
            out[:, w] = np.frombuffer(b"".join([x[i + w * n : i + (w + 1) * n] for x, i, n in zip(raw, starts, sizes, strict=True)]), U8)
        return out.reshape(-1).view(self.dtypes[k])

    def ends(self, name: str) -> np.ndarray:
        """First place of each cell's items, and the number of all items."""
        return np.concatenate([[0], np.cumsum(self.size[:, self.names.index(name)])])


def ask(got: pa.Table, parts: int, order: int = 2, frequent: np.ndarray = np.zeros(0, np.uint64)) -> pa.Table:
    b = Block(_texts(got["text"]), got["trained"].to_numpy(zero_copy_only=False), parts, order, frequent)

    def names(word: np.ndarray) -> list[np.ndarray]:
        """Numbers of words, and the hashes (low bits, high bits) of those that aren't frequent."""
        rest = b.short[word[b.near[word] == FREQUENT]]
        return [b.near[word], rest & np.uint64(0xFFFFFFFF), rest >> np.uint64(32)]

    rows = []
    for p in np.unique(b.shard):
        i, j = np.searchsorted(b.shard, [p, p + 1])
        rare = b.words[i:j][b.numbers[i:j] == FREQUENT]
        row = [int(p), got["block"][0].as_py(), b.numbers[i:j], rare, b.count[i:j]]
        for k, level in enumerate(b.levels, 1):
            if k > 1:  # contexts whose shorter context is the shard's
                fan_of, (i, j) = i, np.searchsorted(level.parent, [i, j])
                row += [np.bincount(level.parent[i:j] - fan_of, minlength=contexts), *names(level.word[i:j])]
            contexts = j - i
            x, y = np.searchsorted(level.context, [i, j])
            row.append(np.bincount(level.context[x:y] - i, minlength=contexts))
            if k == 1:
                row += names(level.key[x:y])
            else:
                first = b.levels[k - 2].first[level.parent[level.context[x:y]]]
                row.append(level.key[x:y] - first)
            row.append(level.count[x:y])
        rows.append(tuple(row))
    return cells(rows, _columns(order)[0])


#: Values (in a lookup: unary bits) that a shard works on at once, so that what it holds for a frequent context stays near its entries.
PIECE = 1 << 18
_ONE, _SIX, _63 = np.uint64(1), np.uint64(6), np.uint64(63)


class EliasFano:
    """A sorted sequence of distinct integers: high bits in unary, low bits packed, in mapped files.

    The unary bits are a one for each value and a zero for the end of each bucket of equal high bits; the number of
    zeros before every 512th bit is the bucket there.
    """

    def __init__(self, values: np.ndarray, universe: int):
        self.n = len(values)
        self.width = np.uint64(min(63, max(0, int(universe // max(self.n, 1)).bit_length() - 1)))
        self.mask = (_ONE << self.width) - _ONE
        self.buckets = int(universe >> int(self.width)) + 1
        high = (values >> self.width).astype(np.int64)
        bits = np.zeros(-(-(self.n + self.buckets + 1) // 512) * 512, bool)
        bits[high + np.arange(self.n)] = True
        self.unary = _mapped(np.packbits(bits, bitorder="little").view(np.uint64))
        zeros = 512 - bits.reshape(-1, 512).sum(1)
        self.sample = _mapped(np.concatenate([[0], np.cumsum(zeros)[:-1]]).astype(np.int64))
        packed = np.zeros((self.n * int(self.width) >> 6) + 2, np.uint64)
        if self.width:
            bit = np.arange(self.n, dtype=np.uint64) * self.width
            word, shift = (bit >> _SIX).astype(np.int64), bit & _63
            low = values & self.mask
            new = np.flatnonzero(_changes(word))  # a value takes under 64 bits, so no word is left out
            if len(new):
                packed[: len(new)] = np.bitwise_or.reduceat(low << shift, new)
                packed[1 : len(new) + 1] |= np.bitwise_or.reduceat((low >> _ONE) >> (_63 - shift), new)
        self.low = _mapped(packed)

    @property
    def nbytes(self) -> int:
        return self.unary.nbytes + self.sample.nbytes + self.low.nbytes

    def lows(self, at: np.ndarray) -> np.ndarray:
        bit = at.astype(np.uint64) * self.width
        word, shift = (bit >> _SIX).astype(np.int64), bit & _63
        return ((self.low[word] >> shift) | ((self.low[word + 1] << _ONE) << (_63 - shift))) & self.mask

    def find(self, values: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
        """Position of each value, or -1; `order` sorts the values, if known.

        One pass over the unary bits, PIECE at a time: the count before a piece tells which values can lie in it.
        """
        order = np.argsort(values) if order is None else order
        values = values[order]
        place = np.int32 if self.n < 1 << 31 else np.int64
        found = np.full(len(values), -1, place)
        for block in range(0, len(self.sample), PIECE >> 9):
            until = min(block + (PIECE >> 9), len(self.sample))
            least = int(self.sample[block])
            most = int(self.sample[until]) if until < len(self.sample) else self.buckets
            ends = [min(x << int(self.width), (1 << 64) - 1) for x in (least, most + 1)]
            some = slice(np.searchsorted(values, np.uint64(ends[0])), np.searchsorted(values, np.uint64(ends[1]), side="right"))
            if some.start == some.stop:
                continue
            bits = np.unpackbits(self.unary[block * 8 : until * 8].view(U8), bitorder="little")
            ones = np.flatnonzero(bits)
            if not len(ones):
                continue
            first = block * 512 - least  # ones before the piece
            high = (ones - np.arange(len(ones)) + least).astype(np.uint64)
            held = (high << self.width) | self.lows(first + np.arange(len(ones)))
            at = np.searchsorted(held, values[some])
            same = at < len(held)
            same[same] = held[at[same]] == values[some][same]
            found[some] = np.where(same, first + at, found[some])
        del values
        out = np.empty(len(order), place)
        out[order] = found
        return out


def _mapped(array: np.ndarray) -> np.ndarray:
    if not len(array):
        return array
    with tempfile.TemporaryFile() as file:  # removed at once; the mapping lives on
        array.tofile(file)
        file.flush()
        return np.memmap(file, dtype=array.dtype, mode="r", shape=array.shape)


def quantise(p: np.ndarray) -> np.ndarray:
    """16-bit codes of probabilities: 1 is probability one, 0 is none."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.round(-np.log10(p) / STEP), 0, 65534) + 1, 0).astype(U16)


_RESTORED = np.append(0.0, 10.0 ** (-np.arange(65535.0) * STEP))


def restore(code: np.ndarray) -> np.ndarray:
    return _RESTORED[code]


def _distinct(ordered: np.ndarray) -> np.ndarray:
    return ordered[_changes(ordered)]


class Trie:
    """A shard's part of the model, built level by level from what all blocks ask; finds what they ask on the way."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        order = np.argsort(words)
        known = _distinct(words[order])
        self.words = EliasFano(known, 1 << 64)
        self.node = self.words.find(words, order)  # of each context asked: its number among those held, or -1
        self.count = np.bincount(self.node, counts, len(known)).astype(np.int64)
        self.contexts = len(known)

    def successors(self, key: np.ndarray, bits: int, fans: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(back-off codes of the contexts asked, codes of the n-grams asked), whose words are told apart by `key`."""
        context = np.repeat(self.node.astype(np.int32), fans)
        can = (context >= 0) & (key >= 0)  # else no text of the training fold has it
        value = np.empty(len(key), np.uint64)
        for i in range(0, len(key), PIECE):
            some = slice(i, i + PIECE)
            value[some] = np.where(can[some], context[some], 0).astype(np.uint64) << np.uint64(bits)
            value[some] |= np.where(can[some], key[some], 0).astype(np.uint64)
        order = np.argsort(value)
        held = _distinct(value[order[counts[order] > 0]])
        grams = EliasFano(held, max(self.contexts, 1) << bits)
        self.at = grams.find(value, order)  # of each n-gram asked: its place among those held, or -1
        del value, order
        count = np.bincount(self.at[counts > 0], counts[counts > 0], len(held))
        self.at[~can] = -1
        owner = (held >> np.uint64(bits)).astype(np.int64)
        total = np.bincount(owner, count, self.contexts)  # times the context occurs
        kinds = np.bincount(owner, minlength=self.contexts)
        backoff = quantise(np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0))
        codes = _mapped(quantise((count - DISCOUNT) / total[owner]) if len(held) else np.zeros(0, U16))
        self.fans = fans
        self.first = np.concatenate([[0], np.cumsum(kinds)])
        self.rank = np.where(self.at >= 0, self.at - self.first.astype(self.at.dtype)[np.maximum(context, 0)], -1)
        certain = quantise(np.ones(1))  # no shorter context's share is lost where a context isn't held
        return (np.append(backoff, certain)[self.node],
                np.where(self.at >= 0, codes[np.maximum(self.at, 0)], 0).astype(U16) if len(codes) else np.zeros(len(key), U16))

    def longer(self, before: np.ndarray, short: np.ndarray, fans: np.ndarray, ranks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One more word of context: `before` counts the longer contexts of each context, `short` are the words before them."""
        shorter = np.repeat(np.arange(len(before)), before)
        gram = (np.cumsum(self.fans) - self.fans)[np.repeat(shorter, fans)]
        gram += ranks  # the n-gram after the shorter context
        key = self.rank[gram]
        del gram, ranks
        node = self.node[shorter]
        value = (np.maximum(node, 0).astype(np.uint64) << np.uint64(40)) | short
        context = np.repeat(np.arange(len(short)), fans)
        seen = np.bincount(context, counts, len(short)) > 0
        order = np.argsort(value)
        held = _distinct(value[order[seen[order]]])
        found = EliasFano(held, max(self.contexts, 1) << 40).find(value, order)
        self.node, self.contexts = np.where(node >= 0, found, -1), len(held)
        del value, order, seen, context, shorter, node, short
        return self.successors(key, int(self.rank.max(initial=0)).bit_length(), fans, counts)


def answer(got: pa.Table, order: int = 2, frequent: np.ndarray = np.zeros(0, np.uint64)) -> pa.Table:
    """Build the shard's trie from all blocks' counts and answer each block in its order."""
    asked = Cells(got, _columns(order)[0])
    take = asked.take
    whole = lambda name: take(name).astype(np.int64)

    def short(k: int) -> np.ndarray:
        rest = take(f"high{k}").astype(np.uint64)
        rest <<= np.uint64(32)
        rest |= take(f"low{k}")
        return named(f"near{k}", frequent >> _SHORT, rest)

    def named(column: str, known: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Each word by its number among the known ones; the rest in their order."""
        number = take(column)
        found = np.append(known, np.zeros(1, np.uint64))[np.minimum(number, len(known))]
        found[number == FREQUENT] = rest
        return found

    trie = Trie(named("numbers", frequent, take("words")), take("counts"))
    told = [trie.count[trie.node]]
    told += trie.successors(short(1).view(np.int64), 40, whole("fans1"), take("grams1"))
    for k in range(2, order):
        told += trie.longer(whole(f"before{k}"), short(k), whole(f"fans{k}"), whole(f"ranks{k}"), take(f"grams{k}"))
    # Entries of each block: words (and contexts of one word) by the words asked, the others by their own columns.
    cuts = [asked.ends("numbers")] * 2
    for k in range(1, order):
        if k > 1:
            cuts.append(asked.ends(f"near{k}"))
        cuts.append(asked.ends(f"grams{k}"))
    keys = zip(got["shard"].to_pylist(), got["block"].to_pylist(), strict=True)
    rows = [(*key, *[x[c[i] : c[i + 1]] for x, c in zip(told, cuts, strict=True)]) for i, key in enumerate(keys)]
    return cells(rows, _columns(order)[1])


def vocabulary(docs: DataFrame, parts: int, frequent: int = FREQUENT) -> tuple[int, int, np.ndarray]:
    """(tokens, distinct tokens) of the training rows, end tokens included, and words that are frequent there, up to `frequent`.

    The frequent words are to shorten what travels; no result depends on which they are.
    """
    columns = {"words": np.dtype(U64), "counts": np.dtype(U32)}
    most = 2 * frequent // parts + 1  # words that a part names: as parts are dealt by hash, about twice its share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            word, _ = tokens(batch.column(0))
            counted = pa.array(word).value_counts()
            some, count = (counted.field(k).to_numpy(zero_copy_only=False) for k in range(2))
            part = (some >> np.uint64(16)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            names, cut = np.unique(part[order], return_index=True)
            groups = [order[a:b] for a, b in zip(cut, [*cut[1:], len(some)], strict=True)]
            yield from cells([(int(p), 0, some[x], count[x]) for p, x in zip(names, groups, strict=True)], columns).to_batches()

    def distinct(got: pa.Table) -> pa.Table:
        got = Cells(got, columns)
        known, number = np.unique(got.take("words"), return_inverse=True)
        count = np.bincount(number, got.take("counts"), len(known)).astype(np.int64)
        top = np.argsort(-count, kind="stable")[:most]
        return pa.table({"n": pa.array([count.sum()], pa.int64()), "v": pa.array([len(known)], pa.int64()),
                         "words": pa.array([known[top].tobytes()], pa.binary()), "counts": pa.array([count[top].tobytes()], pa.binary())})

    found = arrow_map(docs.where("trained").select("text"), run, CELL).groupBy("shard").applyInArrow(
        distinct, "n long, v long, words binary, counts binary").toArrow()
    words, counts = _joined(found["words"], np.uint64), _joined(found["counts"], np.int64)
    top = words[np.lexsort((words, -counts))][: max(frequent - 1, 0)]
    return sum(found["n"].to_pylist()), sum(found["v"].to_pylist()), np.append(BEGIN, top[top != BEGIN])


def score_texts(df: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
                frequent: int = FREQUENT) -> DataFrame:
    """(id, trained, n_tokens, n_known, train_tokens, base_score, score) of every row; `order` words an n-gram, at least two.

    Up to `frequent` words (FREQUENT at most) travel by number; that changes no result.
    """
    if order < 2:
        raise ValueError("an n-gram has two words at least")
    deliver(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                     F.coalesce(train, F.lit(False)).alias("trained"))
    parts = parts_for(docs, 5 << 19)
    n, v, known = vocabulary(docs, parts, min(frequent, FREQUENT))
    blocks = docs.withColumn("block", F.pmod(F.xxhash64("id", "text", F.lit(5)), F.lit(parts)).cast("int"))
    schema = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == "text" else f for f in blocks.schema.fields])

    def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text").cast(pa.large_binary()).to_pylist()
            text = pa.array([None if x is None else squeeze(x) for x in text], pa.binary())
            yield pa.RecordBatch.from_arrays([text if n == "text" else batch.column(n) for n in schema.names], names=schema.names)

    blocks = arrow_map(blocks, squeezed, schema)
    asks = blocks.groupBy("block").applyInArrow(lambda got: ask(got, parts, order, known), CELL)
    answers = asks.groupBy("shard").applyInArrow(lambda got: answer(got, order, known), CELL)
    scores = "id long, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def score(have: pa.Table, told: pa.Table) -> pa.Table:
        if not have.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in (pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2)],
                                        names=["id", "trained", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        b = Block(_texts(have["text"]), have["trained"].to_numpy(zero_copy_only=False), parts, order, known)
        told = Cells(told.sort_by("shard"), _columns(order)[1])
        count = told.take("counts")
        c = count[b.at]
        p = unigram = (c + 1) / (n + v + 1)
        for k, level in enumerate(b.levels, 1):
            backoff, code = (restore(told.take(f"{x}{k}")) for x in ("backoff", "codes"))
            p = code[level.pair] + backoff[level.at] * p
        rows = have.num_rows
        add = lambda w=None: np.bincount(b.row, w, rows)
        return pa.table({"id": have["id"], "trained": have["trained"], "n_tokens": pa.array(add(), pa.int64()),
                         "n_known": pa.array(add(c > 0).astype(np.int64)), "train_tokens": pa.array(np.full(rows, n, np.int64)),
                         "base_score": add(np.log10(unigram)), "score": add(np.log10(p))})

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, scores)


def op2(documents: DataFrame, order: int = 2) -> DataFrame:
    """The contract's columns; the registered query asks for n-grams of ORDER words."""
    out = score_texts(documents, fold(F.col("doc_id"), 7) != 2, order=order)
    return out.select(F.col("id").alias("doc_id"), (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                      "base_score", "score")
