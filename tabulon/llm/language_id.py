"""Language ID with error-correcting output codes.

Every language gets a codeword of plus and minus one.  For each bit a binary classifier over hashed byte
trigrams (log odds of the trigram under the languages on either side, each language counting alike) is fitted
from the counts of all labelled training texts.  A text's bit margins are decoded by loss: the codeword with the
smallest logistic loss, weighted by how well each bit separates its languages, wins.  A text is flagged as ambiguous
if its lead over the second is smaller, or its loss larger, than that of all but REJECT of the training texts that are
decoded to their label: a mixture of languages, a language that was not learned, or letters without sense.

Training counts and limits come from all labelled rows (no sample); what reaches the driver is languages x FEATURES
counts and the texts counted by lead and loss in steps of 1/STEPS.  Null texts and texts without a letter are `und` with score 0; with no labelled row at all every text is
`und`.  Repeated rows each get a row; only the id and text columns are read for a prediction.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import append_columns, arrow_map, fold
from tabulon.llm.words import text_blocks

FEATURES = 1 << 15
UNDEFINED = "und"
#: Languages whose counts a task holds at a time.
HELD = 32
#: Share of the correctly decoded training texts that either limit (lead, loss) may flag.
REJECT = 0.001
STEPS = 1000

_TABLE = np.full(256, 32, np.uint8)
_TABLE[97:123] = np.arange(97, 123)
_TABLE[65:91] = np.arange(97, 123)
_TABLE[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text number) of each byte of a letter run, with its neighbours; a text is padded with spaces."""
    cur = _TABLE[data].astype(np.uint32)
    before, after = np.full_like(cur, 32), np.full_like(cur, 32)
    before[1:], after[:-1] = cur[:-1], cur[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    before[inner], after[inner - 1] = 32, 32
    at = np.flatnonzero(cur != 32)
    code = (before[at] << np.uint32(16)) | (cur[at] << np.uint32(8)) | after[at]
    feature = (code * np.uint32(2654435761)) >> np.uint32(17)
    return feature.astype(np.int64), np.searchsorted(bounds, at, side="right") - 1


def has_letter(texts: pa.Array) -> np.ndarray:
    out = np.zeros(len(texts), bool)
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    for i, j, data, bounds in text_blocks(texts):
        at = np.concatenate([[0], np.cumsum(ascii_letter[data])])
        out[i:j] = at[bounds[1:]] > at[bounds[:-1]]
    for i in np.flatnonzero(~out):
        t = texts[int(i)].as_py()
        out[i] = bool(t) and any(c.isalpha() for c in t)
    return out


def trigram_counts(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, feature, n) over all rows with a label."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("feature", T.IntegerType()),
                           T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush():
            for lang, counts in held.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())],
                    names=["lang", "feature", "n"])
            held.clear()

        for batch in batches:
            langs = batch.column(1).to_pylist()
            for i, j, data, bounds in text_blocks(batch.column(0)):
                feature, text = trigrams(data, bounds)
                here = sorted(set(langs[i:j]))
                number = {x: k for k, x in enumerate(here)}
                of_text = np.array([number[x] for x in langs[i:j]])
                counts = np.bincount(of_text[text] * FEATURES + feature, minlength=len(here) * FEATURES)
                for k, x in enumerate(here):
                    mine = counts[k * FEATURES : (k + 1) * FEATURES]
                    held[x] = held[x] + mine if x in held else mine
                if len(held) > HELD:
                    yield from flush()
        yield from flush()

    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).cast("string"), F.col(lang_col).cast("string"))
    counted = arrow_map(rows, run, schema)
    return counted.groupBy("lang", "feature").agg(F.sum("n").alias("n"))


def code_matrix(n: int, seed: int = 7) -> np.ndarray:
    """n codewords: all splits for up to six languages, else the best of random codes by smallest distance."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        columns = [[1.0 if i == 0 or (bits >> (i - 1)) & 1 == 0 else -1.0 for i in range(n)]
                   for bits in range(1, 1 << (n - 1))]
        return np.array(columns).T
    rng, best, most = np.random.default_rng(seed), None, -1
    width = 10 * int(np.ceil(np.log2(n)))
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (n, width))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = min(int((code[a] != code[b]).sum()) for a, b in combinations(range(n), 2))
        if apart > most:
            best, most = code, apart
    return best


class Codebook:
    """Languages, codewords, bit weights over the features, and the spread of each bit."""

    def __init__(self, languages: list[str], counts: np.ndarray, smoothing: float = 0.5):
        self.languages = languages
        self.code = code_matrix(len(languages))
        n, bits = self.code.shape
        p = (counts + smoothing) / (counts + smoothing).sum(axis=1, keepdims=True) if n else np.zeros((0, FEATURES))
        self.weights = np.zeros((bits if n > 1 else 0, FEATURES), np.float32)
        self.spread = np.ones(len(self.weights))
        for b in range(len(self.weights)):
            side = self.code[:, b] > 0
            w = np.log(p[side].mean(axis=0)) - np.log(p[~side].mean(axis=0))
            expected = p @ w  # margin that each language is expected to give
            middle = (expected[side].min() + expected[~side].max()) / 2
            self.weights[b] = w - middle
            self.spread[b] = max((expected[side].min() - expected[~side].max()) / 2, 1e-3)
        self.least_gap, self.most_loss = 0.0, np.inf

    def set_limits(self, kind: np.ndarray, step: np.ndarray, n: np.ndarray, reject: float = REJECT) -> None:
        """Limits of lead (kind 0) and loss (kind 1) from counts of correctly decoded texts by step."""
        for k in (0, 1):
            at = np.flatnonzero(kind == k)
            if not len(at):
                continue
            at = at[np.argsort(step[at] if k == 0 else -step[at])]
            first = step[at[np.flatnonzero(np.cumsum(n[at]) > reject * n[at].sum())[0]]]
            if k == 0:
                self.least_gap = first / STEPS
            else:
                self.most_loss = (first + 1) / STEPS

    def predict(self, texts: pa.Array) -> dict:
        n = len(texts)
        languages = np.array([*self.languages, UNDEFINED], object)
        letters = has_letter(texts)
        lang, score, gap, least = np.full(n, len(self.languages)), np.zeros(n), np.zeros(n), np.zeros(n)
        if self.languages:
            margins, total = np.zeros((n, len(self.weights))), np.zeros(n)
            for i, j, data, bounds in text_blocks(texts):
                feature, text = trigrams(data, bounds)
                total[i:j] = np.bincount(text, minlength=j - i)
                for b, w in enumerate(self.weights):
                    margins[i:j, b] = np.bincount(text, weights=w[feature], minlength=j - i)
            margins /= np.maximum(total, 1)[:, None] * self.spread
            share = self.spread / self.spread.sum() if len(self.spread) else self.spread
            loss = np.stack([np.logaddexp(0, -4 * margins * c) @ share for c in self.code[:, : len(self.weights)]], axis=1)
            order = np.argsort(loss, axis=1, kind="stable")
            rows = np.arange(n)
            best = order[:, 0]
            weight = np.exp(-4 * (loss - loss[rows, best][:, None]))
            score = np.where(letters, 1 / weight.sum(axis=1), 0.0)
            gap = loss[rows, order[:, 1]] - loss[rows, best] if len(self.languages) > 1 else np.full(n, np.inf)
            lang, least = np.where(letters, best, lang), loss[rows, best]
        return {"lang_pred": languages[lang], "score": score, "has_letter": letters, "gap": gap, "loss": least,
                "ambiguous": letters & bool(self.languages) & ((gap < self.least_gap) | (least > self.most_loss))}


def fit(df: DataFrame, *, text_col: str = "text", lang_col: str = "lang", train: Column | None = None) -> Codebook:
    """Fit on all labelled rows that `train` selects; a second pass over them sets the limits."""
    rows = df if train is None else df.where(train)
    found = trigram_counts(rows, text_col, lang_col).toArrow().combine_chunks()
    names = found["lang"].to_pylist()
    languages = sorted(set(names))
    number = {x: k for k, x in enumerate(languages)}
    counts = np.zeros((len(languages), FEATURES))
    if names:
        counts[np.array([number[x] for x in names]), found["feature"].to_numpy()] = found["n"].to_numpy()
    model = Codebook(languages, counts)
    steps = decoded_steps(rows, model, text_col, lang_col).toArrow().combine_chunks()
    model.set_limits(*(steps[x].to_numpy() for x in ("kind", "step", "n")))
    return model


def decoded_steps(df: DataFrame, model: Codebook, text_col: str, lang_col: str) -> DataFrame:
    """(kind, step, n): correctly decoded labelled texts by lead (kind 0) and by loss (kind 1), in steps."""
    held = df.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("step", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(held.value)
        for batch in batches:
            found = model.predict(batch.column(0))
            right = found["has_letter"] & (found["lang_pred"] == np.array(batch.column(1).to_pylist(), object))
            for kind, x in enumerate((found["gap"], found["loss"])):
                step, n = np.unique(np.floor(x[right & np.isfinite(x)] * STEPS).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(step), kind, np.int32)), pa.array(step), pa.array(n, pa.int64())],
                                                 names=schema.names)

    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).cast("string"), F.col(lang_col).cast("string"))
    return arrow_map(rows, run, schema).groupBy("kind", "step").agg(F.sum("n").alias("n"))


def identify(df: DataFrame, model: Codebook, *, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """The rows with lang_pred, score, has_letter and ambiguous appended; returns the frame and their names.

    The model (bits x FEATURES weights, under a megabyte for ten languages) is broadcast.
    """
    held = df.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    loaded: list[Codebook] = []

    def run(texts: pa.Array) -> dict:
        if not loaded:
            loaded.append(pickle.loads(held.value))
        found = loaded[0].predict(texts)
        return {f.name: found[f.name] for f in fields}

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
              T.StructField("has_letter", T.BooleanType()), T.StructField("ambiguous", T.BooleanType())]
    return append_columns(df, text_col, fields, run)


def training_rows(id_col: str = "doc_id") -> Column:
    return fold(F.col(id_col), 4) != 2


def op9(documents: DataFrame) -> DataFrame:
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    model = fit(docs, train=training_rows())
    out, _ = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those that op 9 flags as ambiguous, go."""
    model = fit(docs, train=training_rows())
    out, names = identify(docs, model)
    return out.where(F.col(names["has_letter"]) & ~F.col(names["ambiguous"])).select(*[F.col(f"`{c}`") for c in docs.columns])
