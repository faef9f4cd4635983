"""The registered LM query sees more than one word of context, and what travels is opened as it was packed."""

import os
import zlib

from pyspark.sql import functions as F

from tabulon.llm import lm_scoring
from tabulon.llm.common import fold
from tabulon.llm.queries import QUERIES


def test_query_scores_two_words_of_context(spark, tmp_path):
    train = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = [(i, "a x c" if k % 2 else "b x d") for k, i in enumerate(train)]
    # Every word follows its neighbour as often in both; only the word before that tells them apart.
    rows += [(held[0], "a x c"), (held[1], "a x d"), (held[2], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op2_lm_score"](spark, str(tmp_path)).collect()}
    assert got[held[0]].score > got[held[1]].score + 1
    assert abs(got[held[0]].base_score - got[held[1]].base_score) < 0.02
    assert got[held[2]].n_tokens == 1
    want = {r.id: r.score for r in lm_scoring.score_texts(docs, fold(F.col("doc_id"), 7) != 2, order=3).collect()}
    assert {i: r.score for i, r in got.items()} == want


def test_packed_arrays():
    for raw in (b"", b"x", bytes(100_000), os.urandom(5000)):
        assert lm_scoring.expand(lm_scoring.squeeze(raw)) == raw
    assert len(lm_scoring.squeeze(bytes(100_000))) < 200
