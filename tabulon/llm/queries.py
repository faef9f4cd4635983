"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabulon.llm import (centroids, chat_format, decontaminate, jaccard_join, language_id, lm_scoring, mixing, neighbours, secret_scan,
                         seed_extend, suffix_dedup, token_counts, whitening)
from tabulon.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _documents(op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: op(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_jaccard_join": _documents(jaccard_join.op1),
    "op2_lm_score": _documents(lambda docs: lm_scoring.op2(docs, lm_scoring.ORDER)),
    "op3_mix_sources": _documents(mixing.op3),
    "op4_nearest_neighbours": lambda s, d: neighbours.op4(table(s, d, "embeddings")),
    "op5_substring_dedup": _documents(seed_extend.op5),
    "op6_suffix_dedup": _documents(suffix_dedup.op6),
    "op7_decontaminate": lambda s, d: decontaminate.op7(table(s, d, "documents"), table(s, d, "benchmark")),
    "op8_secret_scan": _documents(secret_scan.op8),
    "op9_language_id": _documents(language_id.op9),
    "op10_token_counts": _documents(lambda docs: token_counts.op10(docs, public_tokenizers.path("piece_bpe_32k.model"))),
    "op11_chat_format": lambda s, d: chat_format.op11(table(s, d, "conversations")),
    "op12_whitening": lambda s, d: whitening.op12(table(s, d, "embeddings")),
    "op13_centroid_clusters": lambda s, d: centroids.op13(table(s, d, "embeddings")),
}

ORACLES: dict[str, str] = {
    "op3_mix_sources": mixing.sql(),
    "op5_substring_dedup": seed_extend.SQL,
    "op7_decontaminate": decontaminate.SQL,
    "op11_chat_format": chat_format.sql(),
    "op13_centroid_clusters": centroids.SQL,
}
