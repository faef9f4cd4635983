"""Records of delimited text whose quoted fields span lines, read in splits.

Whether a line begins inside quotes depends on all lines before it in its file.  Each line is a small function from the
state it begins in (outside or inside quotes) to the state it ends in, and such functions compose: one pass over the
lines composes them for each split of each file, the splits (one row each) are combined in file order on the driver,
and a second pass, now knowing in which state its split begins, joins the lines of each record.  Only a record that
crosses the border of two splits is put together by a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.operators.ordering import FILE, POS, START
from tabulon.session import deliver


def _patterns(sep: str) -> tuple[str, str]:
    """Lines that end outside quotes: those that begin outside, and those that begin inside.

    Every repetition is possessive, which Java runs as a loop: lines may be of any length.
    """
    s = re.sub(r"([^A-Za-z0-9])", r"\\\1", sep) if sep != "\t" else r"\t"
    inside, rest = r'(?:[^"]++|"")*+"', f"[^{s}]*+"
    field = f'(?:"{inside}{rest}|[^"{s}]{rest})?+'
    return f"^{field}(?:{s}{field})*+\\z", f"^{inside}{rest}(?:{s}{field})*+\\z"


def open_line(line: Column, sep: str) -> Column:
    """Begun outside quotes, the line ends inside them."""
    return F.contains(line, F.lit('"')) & ~line.rlike(_patterns(sep)[0])


def stays_open(line: Column, sep: str) -> Column:
    """Begun inside quotes, the line ends inside them."""
    return ~(F.contains(line, F.lit('"')) & line.rlike(_patterns(sep)[1]))


def _lines(spark: SparkSession, paths: list[str], sep: str, encoding: str) -> DataFrame:
    """(file, start, line, f0, f1) in the order of the file within a split; a carriage return at the end stays."""
    text = F.decode(F.col("value").cast("binary"), encoding) if encoding != "UTF-8" else F.col("value")
    raw = spark.read.option("lineSep", "\n").text(paths)
    return (raw.select(F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(START), text.alias("line"))
            .select("*", open_line(F.col("line"), sep).alias("f0"), stays_open(F.col("line"), sep).alias("f1")))


def states(f0: np.ndarray, f1: np.ndarray, begin: bool) -> tuple[np.ndarray, np.ndarray]:
    """State before and after each line: since the last line that ends alike from both states, only toggles count."""
    fixed = np.maximum.accumulate(np.where(f0 == f1, np.arange(len(f0)), -1))
    toggles = np.cumsum(f0 & ~f1)
    since = np.where(fixed >= 0, toggles - toggles[fixed], toggles)
    after = np.where(fixed >= 0, f0[fixed], begin) ^ (since % 2 == 1)
    return np.concatenate([[begin], after[:-1]]).astype(bool), after.astype(bool)


def _flags(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False).astype(bool) for n in names]


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The rows of a batch by split, in order."""
    start, file = batch.column(START).to_numpy(), batch.column(FILE)
    new = np.flatnonzero(np.concatenate([[True], (start[1:] != start[:-1]) | pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)]))
    for a, b in zip(new, [*new[1:], batch.num_rows], strict=True):
        yield (file[int(a)].as_py(), int(start[a])), batch.slice(a, b - a)


PIECE = T.StructType([T.StructField(FILE, T.StringType()), T.StructField(START, T.LongType()), T.StructField("g0", T.BooleanType()),
                      T.StructField("g1", T.BooleanType()), T.StructField("begins", T.BooleanType())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split: its state at the end from either state at its beginning, and whether a record begins in it if it
    begins inside quotes."""
    found: dict[tuple[str, int], list[bool]] = {}
    for batch in batches:
        for key, run in _runs(batch) if batch.num_rows else ():
            g = found.setdefault(key, [False, True, False])
            f0, f1 = _flags(run, "f0", "f1")
            g[0] = bool(states(f0, f1, g[0])[1][-1])
            before, after = states(f0, f1, g[1])
            g[1], g[2] = bool(after[-1]), g[2] or not before.all()
    yield pa.RecordBatch.from_pylist([{FILE: f, START: s, "g0": g0, "g1": g1, "begins": b} for (f, s), (g0, g1, b) in found.items()],
                                     schema=pa.schema([(FILE, pa.string()), (START, pa.int64()), ("g0", pa.bool_()), ("g1", pa.bool_()),
                                                       ("begins", pa.bool_())]))


def split_states(lines: DataFrame) -> tuple[dict[tuple[str, int], tuple[bool, int]], dict[str, bool]]:
    """((begins inside, the split in which the record open at its beginning began) by split, final state by file)."""
    deliver(lines.sparkSession)
    pieces = sorted(tuple(r) for r in lines.select(FILE, START, "f0", "f1").mapInArrow(_pieces, PIECE).collect())  # a row for each split
    begin, last = {}, {}
    owner = 0
    for f, s, g0, g1, begins in pieces:
        state = last.get(f, False)
        owner = owner if state else s
        begin[f, s] = (state, owner)
        last[f] = g1 if state else g0
        # the record that is open at the end of this split began in it, unless it runs through from before
        owner = s if not state or begins else owner
    return begin, last


def balanced_files(spark: SparkSession, paths: list[str], sep: str) -> list[str]:
    """The files (as `_metadata` names them) whose quotes are all closed at the end."""
    return [f for f, state in split_states(_lines(spark, paths, sep, "ISO-8859-1"))[1].items() if not state]


RECORD = T.StructType([T.StructField(FILE, T.StringType()), T.StructField(START, T.LongType()), T.StructField(POS, T.LongType()),
                       T.StructField("record", T.StringType()), T.StructField("at", T.LongType())])


def read_records(spark: SparkSession, paths: list[str], sep: str, encoding: str) -> DataFrame:
    """(file, start, pos, record): every record but blank ones, with the split and the line in it where it begins."""
    lines = _lines(spark, paths, sep, encoding)
    begin = spark.sparkContext.broadcast(split_states(lines)[0])  # an entry for each split

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, line, buffer, first, owner = None, False, 0, [], 0, 0
        for batch in batches:
            rows: list[tuple] = []
            singles = []
            for at, part in _runs(batch) if batch.num_rows else ():
                if at != key:
                    if buffer:
                        rows.append((key[0], owner, first, "\n".join(buffer), key[1]))
                    key, line, buffer = at, 0, []
                    state, owner = begin.value[at]
                    first = -1 if state else 0
                before, after = states(*_flags(part, "f0", "f1"), state)
                alone = ~before & ~after
                singles.append((at, part.column("line").filter(pa.array(alone)), np.flatnonzero(alone) + line))
                for i in np.flatnonzero(~alone):
                    if not before[i]:
                        buffer, first, owner = [], int(i) + line, at[1]
                    buffer.append(part.column("line")[int(i)].as_py())
                    if not after[i]:
                        whole = first >= 0
                        rows.append((at[0], owner, first, "\n".join(buffer), None if whole else at[1]))
                        buffer = []
                state, line = bool(after[-1]), line + part.num_rows
            for at, text, pos in singles:
                n = len(text)
                yield pa.RecordBatch.from_arrays([pa.array([at[0]] * n, pa.string()), pa.array(np.full(n, at[1]), pa.int64()), pa.array(pos, pa.int64()),
                                                  text, pa.nulls(n, pa.int64())], names=RECORD.names)
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(RECORD.names, r, strict=True)) for r in rows], schema=_ARROW)
        if buffer:
            yield pa.RecordBatch.from_pylist([dict(zip(RECORD.names, (key[0], owner, first, "\n".join(buffer), key[1]), strict=True))], schema=_ARROW)

    cut = lines.mapInArrow(run, RECORD)
    whole = cut.where("at IS NULL").drop("at")
    # Pieces of records over a border: at most two a split; the piece with the record's beginning has its line.
    joined = (cut.where("at IS NOT NULL").groupBy(FILE, START).agg(
        F.max(POS).alias(POS), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "record"))), lambda x: x["record"]), "\n").alias("record")))
    ended = F.regexp_replace("record", r"\r\z", "")
    return whole.union(joined).withColumn("record", ended).where(F.trim("record") != "")


_ARROW = pa.schema([(FILE, pa.string()), (START, pa.int64()), (POS, pa.int64()), ("record", pa.string()), ("at", pa.int64())])
