"""What the LM operator's blocks send: frequent words by number, with the same results, and lookups in one pass."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tabulon.llm import lm_scoring


def zipf_texts(n, words=30_000, seed=5):
    rng = np.random.default_rng(seed)
    drawn = np.minimum(rng.zipf(1.3, (n, 60)), words)
    return [" ".join(f"w{x}" for x in row) for row in drawn]


def block_of(texts):
    return pa.table({"text": pa.array([lm_scoring.squeeze(x.encode()) for x in texts], pa.binary()),
                     "trained": pa.array([True] * len(texts)), "block": pa.array([0] * len(texts), pa.int32())})


def test_scores_do_not_depend_on_the_frequent_words(spark):
    rows = [(i, x) for i, x in enumerate(zipf_texts(120, 400))] + [(120, None), (None, "w1 w2"), (7, "w1 w2 w3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    some = F.coalesce(F.col("doc_id"), F.lit(1)) % 4 != 2
    key = lambda r: (r.id is None, r.id or 0, r.n_tokens, r.score)
    got = [sorted(lm_scoring.score_texts(docs, some, frequent=k).collect(), key=key) for k in (0, 7, lm_scoring.FREQUENT)]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)


def test_asked_bytes():
    block = block_of(zipf_texts(3000))
    word, _ = lm_scoring.tokens(lm_scoring._texts(block["text"]))
    seen, count = np.unique(word, return_counts=True)
    frequent = np.append(lm_scoring.BEGIN, seen[np.argsort(-count, kind="stable")][:2000])
    asked = lm_scoring.ask(block, 8, 3, frequent)
    size = sum(len(x) for name in asked.column_names[2:] for x in asked[name].to_pylist())
    assert lm_scoring.Cells(asked, lm_scoring._columns(3)[0]).take("counts").sum() == len(word)
    assert size < 2.5 * len(word)  # 1.8 bytes a token; 3.5 when every word travelled as a hash


def test_numbered():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5000):
        x = rng.integers(0, 3000, n)
        for limit in (3000, 1 << 63):  # packed with its place, and too large for that
            values, number = lm_scoring._numbered(x, limit)
            want, at = np.unique(x, return_inverse=True)
            assert (values == want).all() and (number == at).all()


def test_find_over_many_pieces(monkeypatch):
    monkeypatch.setattr(lm_scoring, "PIECE", 512)
    rng = np.random.default_rng(2)
    for universe in (1 << 64, 1 << 40, 30_000):
        held = np.unique(np.concatenate([rng.integers(0, universe - 1, 9000, np.uint64, endpoint=True), np.array([0, universe - 1], np.uint64)]))
        asked = np.concatenate([held[::3], held[::7], rng.integers(0, universe - 1, 5000, np.uint64, endpoint=True)])
        rng.shuffle(asked)
        want = np.where(np.isin(asked, held), np.searchsorted(held, asked), -1)
        assert (lm_scoring.EliasFano(held, universe).find(asked) == want).all()
