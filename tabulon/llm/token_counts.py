"""Token counts: a BPE vocabulary compiled lazily into a deterministic finite-state transducer.

The encoding of a text by priority merges is the one sequence of pieces in which every two neighbours,
merged on their own, stay as they are.  So the last piece of each prefix follows from a bounded number of
earlier characters: the longest suffix that starts some piece, with the last piece and relative count at each
of its positions.  These configurations are the states.  A transition on a character is annotated with the
change of the token count.  States and transitions are built when first met.

A text falls apart at reset points, where no piece can cross (before a run of spaces; around characters that
occur in no longer piece).  The state map of a chunk is therefore (head before the first reset, tokens in
between, tail after the last reset), and maps of neighbouring chunks compose associatively: a pairwise scan
over the chunks of a text gives its count.

Null and empty texts have 0 tokens and 0 bytes.  Texts are handled whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import map_text

SPACE = "▁"
CHUNK_CHARS = 1 << 16
#: Bounds of the memory used by what is only kept for speed; past them it is built anew.
MAX_STATES, MAX_SEGMENTS, LONG_SEGMENT = 300_000, 600_000, 48


class Transducer:
    """Counts the tokens that a sentencepiece BPE model (byte fallback, dummy prefix) gives a text."""

    def __init__(self, model_path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model_path)
        special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not special(i)}
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece has a space after another character: texts have no reset points")
        if sp.encode(" a") == sp.encode("a"):
            raise ValueError("models that remove spaces are not supported")
        self.starts = {p[:k] for p in self.score for k in range(1, len(p) + 1)}
        joined = {c for p in self.score if len(p) > 1 for c in p}
        alone = "".join(c for c in "\n\r\t" if c not in joined)
        self.alone = alone
        lone = f"[{re.escape(alone)}]|" if alone else ""
        rest = f"[^{SPACE}{re.escape(alone)}]"
        self.segments = re.compile(f"{SPACE}+{rest}*|{lone}{rest}+")
        self.reset = re.compile(f"(?<!{SPACE}){SPACE}" + (f"|[{re.escape(alone)}]|(?<=[{re.escape(alone)}])." if alone else ""), re.S)
        self.pair: dict[tuple[str, str], bool] = {}
        self.counts: dict[str, int] = {c: self._lone(c) for c in alone}
        self._clear()

    def _clear(self) -> None:
        #: state 0 is the start of a segment; a state is (suffix, last pieces, relative counts, at start)
        self.keys = [("", ("",), (0,), True)]
        self.number = {self.keys[0]: 0}
        self.next: list[dict[str, tuple[int, int]]] = [{}]

    def _lone(self, c: str) -> int:
        return 1 if c in self.score else len(c.encode("utf-8", "surrogatepass"))

    def merge(self, text: str) -> list[str]:
        """Priority merges of a short text: the best-scored neighbours first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stays(self, left: str, right: str) -> bool:
        known = self.pair.get((left, right))
        if known is None:
            if len(self.pair) > 4 * MAX_STATES:
                self.pair.clear()
            known = self.pair[left, right] = self.merge(left + right) == [left, right]
        return known

    def _step(self, state: int, c: str) -> tuple[int, int]:
        suffix, last, rel, start = self.keys[state]
        grown = suffix + c
        end, score, pair = len(grown) - 1, self.score, self.pair
        # A piece that ends here begins at one of the remembered positions.
        for at in range(end + 1):
            piece = grown[at:]
            if piece in score or at == end:
                if at == 0 and start:
                    break
                stays = pair.get((last[at], piece))
                if stays is None:
                    stays = self.stays(last[at], piece)
                if stays:
                    break
        else:
            raise AssertionError(f"no piece ends {grown!r}")
        delta = rel[at] + (1 if piece in score else self._lone(piece))
        cut, starts = 0, self.starts
        while cut <= end and grown[cut:] not in starts:
            cut += 1
        key = grown[cut:], (*last[cut:], piece), (*[r - delta for r in rel[cut:]], 0), start and cut == 0
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.keys)
            self.keys.append(key)
            self.next.append({})
        self.next[state][c] = to, delta
        return to, delta

    def run(self, segment: str) -> int:
        """Tokens of one segment: the sum of the annotations on its path."""
        if len(self.keys) > MAX_STATES:
            self._clear()
        state, total = 0, 0
        for c in segment:
            hop = self.next[state].get(c)
            if hop is None:
                hop = self._step(state, c)
            state = hop[0]
            total += hop[1]
        return total

    def whole(self, text: str) -> int:
        """Tokens of a text that starts and ends at reset points."""
        parts, counts = self.segments.findall(text), self.counts
        try:
            return sum(map(counts.__getitem__, parts))
        except KeyError:
            pass
        if len(counts) > MAX_SEGMENTS:
            counts.clear()
            counts.update((c, self._lone(c)) for c in self.alone)
        long = 0
        for s in {*parts}.difference(counts):
            if len(s) <= LONG_SEGMENT:
                counts[s] = self.run(s)
            else:
                long += self.run(s) * parts.count(s)
        return sum(map(counts.__getitem__, parts) if not long else (counts.get(s, 0) for s in parts)) + long

    def chunk_map(self, chunk: str) -> tuple[str, int | None, str]:
        """(head, tokens, tail); tokens is None where the chunk has no reset point (then tail is empty)."""
        first = self.reset.search(chunk)
        if first is None:
            return chunk, None, ""
        a = first.start()
        # the last segment may go on in the next chunk
        b = a
        for m in self.reset.finditer(chunk, max(a, len(chunk) - 4 * LONG_SEGMENT)):
            b = m.start()
        if b == a:
            for m in self.reset.finditer(chunk, a):
                b = m.start()
        return chunk[:a], self.whole(chunk[a:b]), chunk[b:]

    def compose(self, x: tuple, y: tuple) -> tuple:
        """The map of two neighbouring chunks."""
        if x[1] is None and y[1] is None:
            return x[0] + y[0], None, ""
        if x[1] is None:
            return x[0] + y[0], y[1], y[2]
        if y[1] is None:
            return x[0], x[1], x[2] + y[0]
        return x[0], x[1] + self.whole(x[2] + y[0]) + y[1], y[2]

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if len(text) <= CHUNK_CHARS:
            return self.whole(text)
        maps, at = [], 0
        while at < len(text):
            to = min(len(text), at + CHUNK_CHARS)
            while to < len(text) and text[to] == SPACE:  # a chunk doesn't start inside a run of spaces
                to += 1
            maps.append(self.chunk_map(text[at:to]))
            at = to
        while len(maps) > 1:  # pairwise scan
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, n, tail = maps[0]
        return self.whole(head) + (0 if n is None else n + self.whole(tail))


@lru_cache(maxsize=2)
def _compiled(model_path: str) -> Transducer:
    return Transducer(model_path)


def token_counts(df: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes long, n_tokens long) of every row, as sentencepiece encodes it without begin or end tokens.

    A map without shuffle: each task compiles the transducer from the vocabulary file at `model_path` (on
    every node).  Repeated rows and null ids give a row each; other columns are not read.
    """
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType())])

    def run(batch: pa.RecordBatch):
        fst = _compiled(model_path)
        texts = batch.column(1)
        yield {id_col: batch.column(0), "n_bytes": pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()),
               "n_tokens": [fst.count(t.as_py()) for t in texts]}

    return map_text(df.withColumn(text_col, F.col(text_col).cast("string")), [id_col, text_col], run, schema)


def op10(df: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    return token_counts(df, model_path).withColumn("over_limit", F.col("n_tokens") > limit)
