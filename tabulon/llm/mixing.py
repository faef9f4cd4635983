"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic).  Sampling probabilities of the cells start at the sampling
rate and are raked in turn to the source, language and topic marginals of the expected tokens; a probability that
would pass one is held at one.  Then documents are drawn by their cell's probability with a hash of the id, so the
expected token shares of the sample meet the targets wherever the cells allow it.

Categories that the targets don't name, null among them, are the category OTHER; the number of cells is at most
the product of the parameter sizes, which bounds what reaches the driver and what is broadcast.  Target shares are
rescaled to the categories that have tokens.  Null texts have no tokens; a cell without tokens keeps the sampling
rate.  Repeated rows are decided alike.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import fresh

OTHER = "*"
DIMENSIONS = ("source", "lang", "topic")
ROUNDS = 40
RATE = 0.5
WORD = r"[^\x20\x09-\x0D]+"

#: Topics by the first rule that a text matches; a parameter.
TOPICS: dict[str, str] = {
    "legal": r"(?i)licen[cs]e|copyright|all rights reserved",
    "contact": r"[A-Za-z0-9_.+-]@[A-Za-z0-9-]+[.][A-Za-z]",
    "table": r"[|].*[|].*[|]",
}
GENERAL = "general"

#: Target shares of the tokens; a parameter.
TARGETS: dict[str, dict[str, float]] = {
    "source": {**{f"src{i}": 0.98 / 20 for i in range(20)}, OTHER: 0.02},
    "lang": {"en": 0.5, "de": 0.18, "fr": 0.18, "es": 0.12, OTHER: 0.02},
    "topic": {GENERAL: 0.8, "legal": 0.08, "contact": 0.07, "table": 0.05},
}


def topic_of(text: Column, topics: Mapping[str, str] = TOPICS) -> Column:
    out = F.lit(GENERAL)
    for name, rule in reversed(topics.items()):
        out = F.when(text.rlike(rule), F.lit(name)).otherwise(out)
    return out


def _category(value: Column, shares: Mapping[str, float]) -> Column:
    return F.when(value.isin([c for c in shares if c != OTHER]), value).otherwise(F.lit(OTHER))


def rake(tokens: dict[tuple[str, ...], int], targets: Mapping[str, Mapping[str, float]], rate: float,
         rounds: int = ROUNDS) -> dict[tuple[str, ...], float]:
    """Sampling probability of each cell."""
    cells = sorted(tokens)
    n = np.array([tokens[c] for c in cells], float)
    p = np.full(len(cells), float(rate))
    margins = []
    for d, dim in enumerate(targets):
        names = sorted({c[d] for c in cells})
        at = np.array([names.index(c[d]) for c in cells], int)
        here = np.bincount(at, n, len(names)) > 0
        share = np.array([targets[dim].get(x, 0.0) for x in names]) * here
        if share.sum() > 0:
            margins.append((at, share / share.sum() * rate * n.sum(), len(names)))
    for _ in range(rounds):
        for at, goal, size in margins:
            now = np.bincount(at, n * p, size)
            p = np.minimum(1.0, np.where(now[at] > 0, p * goal[at] / np.where(now > 0, now, 1.0)[at], p))
    return dict(zip(cells, p.tolist(), strict=True))


def mix(df: DataFrame, *, targets: Mapping[str, Mapping[str, float]] = TARGETS, topics: Mapping[str, str] = TOPICS,
        rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> tuple[DataFrame, dict[str, str]]:
    """The rows with topic, n_tokens, probability, weight and selected appended; returns the frame and their names."""
    names: dict[str, str] = {}
    for x in ("topic", "n_tokens", "probability", "weight", "selected"):
        names[x] = fresh(x, [*df.columns, *names.values()])
    keys = []
    for d in DIMENSIONS:
        keys.append(fresh(f"cell_{d}", [*df.columns, *names.values(), *keys]))
    text = F.col(text_col)
    full = (df.withColumn(names["topic"], topic_of(F.coalesce(text, F.lit("")), topics))
            .withColumn(names["n_tokens"], F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")))
    values = (F.col("source"), F.col("lang"), F.col(names["topic"]))
    full = full.withColumns({k: _category(v, targets[d]) for k, d, v in zip(keys, DIMENSIONS, values, strict=True)})
    cells = full.groupBy(*keys).agg(F.sum(names["n_tokens"]).alias("n")).collect()  # at most the parameters' product
    tokens = {tuple(r[k] for k in keys): r["n"] for r in cells}
    p = rake(tokens, targets, rate, rounds)
    bound = 1
    for d in DIMENSIONS:
        bound *= len(targets[d]) + 1
    assert len(p) <= bound
    spark = df.sparkSession
    table = spark.createDataFrame([(*c, x) for c, x in p.items()] or [("", "", "", 0.0)],
                                  ", ".join(f"`{k}` string" for k in keys) + f", `{names['probability']}` double")
    u = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    out = full.join(F.broadcast(table), keys, "left").withColumn(
        names["probability"], F.coalesce(F.col(names["probability"]), F.lit(float(rate))))
    out = out.withColumn(names["weight"], F.col(names["probability"]) / F.lit(float(rate)))
    out = out.withColumn(names["selected"], u < F.col(names["probability"]))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *names.values()), names


def op3(documents: DataFrame) -> DataFrame:
    out, _ = mix(documents.select("doc_id", "source", "lang", F.col("text").cast("string").alias("text")))
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 9).alias("probability"),
                      F.round("weight", 9).alias("weight"), "selected")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled documents, with their weight and sampling probability."""
    out, names = mix(docs)
    return out.where(names["selected"]).select(*[F.col(f"`{c}`") for c in docs.columns], names["topic"], names["weight"], names["probability"])


def sql(targets: Mapping[str, Mapping[str, float]] = TARGETS, topics: Mapping[str, str] = TOPICS, rate: float = RATE,
        rounds: int = ROUNDS) -> str:
    """The same in SQL, with the rounds written out."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    topic = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(text, ''), {quote(r)}) THEN {quote(t)}" for t, r in topics.items()) + f" ELSE {quote(GENERAL)} END"
    named = lambda d: ", ".join(quote(c) for c in targets[d] if c != OTHER)
    parts = [f"""d AS MATERIALIZED (SELECT *, CASE WHEN source IN ({named('source')}) THEN source ELSE '*' END AS c_source,
  CASE WHEN lang IN ({named('lang')}) THEN lang ELSE '*' END AS c_lang,
  CASE WHEN topic IN ({named('topic')}) THEN topic ELSE '*' END AS c_topic
  FROM (SELECT doc_id, source, lang, {topic} AS topic,
        CAST(coalesce(len(regexp_extract_all(text, {quote(WORD)})), 0) AS BIGINT) AS n_tokens FROM documents))""",
             f"""r0 AS MATERIALIZED (SELECT c_source, c_lang, c_topic, CAST(sum(n_tokens) AS DOUBLE) AS n, CAST({rate} AS DOUBLE) AS p
  FROM d GROUP BY ALL)"""]
    for dim in DIMENSIONS:
        values = ", ".join(f"({quote(c)}, CAST({s!r} AS DOUBLE))" for c, s in targets[dim].items())
        parts.append(f"""g_{dim} AS MATERIALIZED (SELECT c, s / sum(s) OVER () * {rate} * (SELECT sum(n) FROM r0) AS goal
  FROM (VALUES {values}) AS t(c, s) WHERE c IN (SELECT c_{dim} FROM r0 GROUP BY 1 HAVING sum(n) > 0))""")
    k = 0
    for _, dim in product(range(rounds), DIMENSIONS):
        parts.append(f"""r{k + 1} AS MATERIALIZED (SELECT c_source, c_lang, c_topic, n,
  least(1.0, CASE WHEN now > 0 THEN p * coalesce(goal, 0) / now ELSE p END) AS p
  FROM (SELECT *, sum(n * p) OVER (PARTITION BY c_{dim}) AS now FROM r{k}) LEFT JOIN g_{dim} ON c = c_{dim})""")
        k += 1
    body = ",\n".join(parts)
    return f"""WITH {body}
SELECT doc_id, source, lang, topic, n_tokens, round(p, 9) AS probability, round(p / {rate}, 9) AS weight,
  CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) / 4294967296.0 < p AS selected
FROM d JOIN r{k} USING (c_source, c_lang, c_topic)"""
