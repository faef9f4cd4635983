"""Chat formatting, whitening and centroid clustering against plain re-computations, with awkward rows."""

import hashlib
import itertools
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import centroids, chat_format, whitening
from tests.oracle import compare

# ---------------------------------------------------------------- chat formatting

CHATS = "conv_id long, turn long, role string, text string, conv string, turns string, loss boolean"
MARKS = chat_format.LLAMA_LIKE.marks()


def chats():
    rng = random.Random(3)
    bits = [*MARKS, "\\", "\\\\", "[", "<", "</", "s>", "INST]", "\n", "é", "😀", " ", "word ", "$0", "$1", "[\\INST]"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
    rows = [(1, 0, "user", None), (1, 0, "user", ""), (1, 1, None, "a"), (1, None, "assistant", "first"), (2, 3, "assistant", "only"),
            (None, 1, "assistant", "no id"), (None, 0, "tool", "x"), (3, 0, "user", "<"), (3, 1, "assistant", "/s>"), (3, 1, "assistant", "/s>")]
    rows += [(c, t, rng.choice(["user", "assistant", "system", "tool", "[ROLE]", ""]), text()) for c in range(10, 60) for t in range(rng.randrange(1, 9))]
    rows += [(9, t, ["user", "assistant"][t % 2], f"turn {t}") for t in range(3000)] + [(8, 0, "assistant", "x" * 200_000)]
    return rows


@pytest.fixture(scope="module")
def talks(spark):
    return spark.createDataFrame([(*r, "c", "t", True) for r in chats()], CHATS).repartition(5)


def by_conversation(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c, turns in itertools.groupby(sorted(rows, key=key), lambda r: r[0]):
        yield c, [(r[2] or "", r[3] or "") for r in turns]


def test_chat_digests(talks):
    planted = [(-1, 0, "user", chat_format.PLANTED_TEXT), (-1, 1, "assistant", chat_format.PLANTED_TEXT)]
    want = {}
    for c, turns in by_conversation(chats() + planted):
        loss = "".join(t for r, t in turns if r == "assistant")
        want[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss),
                   hashlib.sha256(loss.encode()).hexdigest())
    got = {r.conv_id: tuple(r)[1:5] for r in chat_format.op11(talks).collect()}
    assert got == want


def test_chat_messages_and_mask(talks):
    for r in chat_format.format_chats(talks).collect():
        turns = dict(by_conversation(chats()))[r.conv]
        runs = [list(g) for _, g in itertools.groupby(turns, lambda t: t[0])]
        esc = lambda t: _escaped(t)
        marks = chat_format.LLAMA_LIKE.roles
        want = "".join((marks[g[0][0]][0] if g[0][0] in marks else f"[ROLE]{esc(g[0][0])}[/ROLE]") + "[ALSO]".join(esc(t) for _, t in g)
                       + (marks[g[0][0]][1] if g[0][0] in marks else "[/TEXT]") for g in runs)
        assert r.formatted == want
        at, learned = 0, []
        for run in r.loss_runs:
            learned += [r.formatted[at:at + run.chars]] * run.loss
            at += run.chars
        assert at == len(r.formatted) and all(run.chars for run in r.loss_runs)
        assert "".join(learned) == "".join(esc(t) for role, t in turns if role == "assistant")


def _escaped(text):
    out, i = "", 0
    while i < len(text):
        out += text[i] + ("\\" if text[i] == "\\" or any(text.startswith(m, i) for m in MARKS) else "")
        i += 1
    return out


def test_chat_sql(talks, tmp_path):
    talks.write.parquet(f"{tmp_path}/c")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    ok, msg = compare(chat_format.op11(talks), con, chat_format.sql())
    assert ok, msg


def test_chat_other_template_and_empty_table(spark, talks):
    own = chat_format.Template(roles={"user": ("<|user|>", "<|end user|>")}, other=("<|role|>", "<|of|>", "<|end|>"), also="<|also|>", learned=("tool", "user"))
    f = chat_format.format_chats(talks, own)
    for r in f.select("conv", chat_format.read_turns(F.col("formatted"), own).alias("turns"),
                      chat_format.read_loss(F.col("formatted"), F.col("loss_runs"), own).alias("loss")).collect():
        turns = dict(by_conversation(chats()))[r.conv]
        assert [tuple(t) for t in r.turns] == turns
        assert r.loss == "".join(t for role, t in turns if role in ("tool", "user"))
    assert chat_format.format_chats(spark.createDataFrame([], CHATS)).count() == 0
    assert [r.conv_id for r in chat_format.op11(spark.createDataFrame([], CHATS)).collect()] == [-1]
    for bad in ("a", "x\\y", "[INST", "T]x"):
        with pytest.raises(ValueError):
            chat_format.Template(also=bad)


def test_chat_mask_must_fit(spark):
    df = spark.createDataFrame([("<s>abc</s>", [(3, False), (2, True), (5, False)])], "formatted string, loss_runs array<struct<chars:long,loss:boolean>>")
    with pytest.raises(Exception, match="doesn't fit"):
        df.select(chat_format.read_loss(F.col("formatted"), F.col("loss_runs"))).collect()


# ---------------------------------------------------------------- whitening

VECTORS = "vec_id long, embedding array<double>, id string, v string, component int"


def vectors(dim, n=700, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)) @ np.diag(np.linspace(3, 0.2, dim)) @ rng.standard_normal((dim, dim)) * 0.1 + 40
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [rows[5], (5, rows[6][1]), (None, rows[7][1])]
    bad = [(900, None), (901, [None, *rows[0][1][1:]]), (902, [math.nan, *rows[0][1][1:]]), (903, [math.inf, *rows[0][1][1:]]),
           (904, []), (905, rows[0][1][1:]), (906, [1e300, *rows[0][1][1:]])]
    return rows, bad


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", 7) for i, v in rows], VECTORS).repartition(4)


def whitened_by_hand(rows, k=8):
    x = np.floor(1024 * np.array([v for _, v in rows])).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    dev = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    return y @ u / np.sqrt(e), e / (y ** 2).sum() * n, dev


@pytest.mark.parametrize("dim", [12, 3])
def test_whitening(spark, dim):
    rows, bad = vectors(dim)
    got = whitening.op12(frame(spark, rows + bad)).toPandas()
    k = min(dim, 8)
    w, explained, dev = whitened_by_hand(rows, k)
    assert len(got) == len(rows) * k and set(got.component) == set(range(1, k + 1)) and set(got.n) == {len(rows)}
    order = lambda ids, d, x: sorted(zip([-1 if i is None or i != i else int(i) for i in ids], map(int, d), x))
    for c in range(1, k + 1):
        mine = got[got.component == c]
        sign = np.sign((mine.whitened ** 3).sum()) * np.sign((w[:, c - 1] ** 3).sum())
        assert np.allclose(mine.explained, explained[c - 1], rtol=1e-9)
        a = order(mine.vec_id, mine.deviation, sign * mine.whitened)
        b = order([i for i, _ in rows], dev, w[:, c - 1])
        assert [x[:2] for x in a] == [x[:2] for x in b]
        assert np.allclose([x[2] for x in a], [x[2] for x in b], atol=1e-8)
    assert got.identity_error.nunique() == 1 and 0 <= got.identity_error[0] < 1e-9


def test_whitening_degenerate(spark):
    rng = np.random.default_rng(2)
    flat = [(i, [float(a), 5.0, float(a) * 2, float(b)]) for i, (a, b) in enumerate(rng.integers(-40, 40, (300, 2)) / 8)]
    got = whitening.op12(frame(spark, flat)).toPandas()
    assert set(got.component) == {1, 2} and got.identity_error[0] < 1e-9  # a constant and a repeated dimension: rank two
    w, explained, _ = whitened_by_hand(flat, 2)
    assert np.allclose(got[got.component == 1].explained, explained[0]) and np.allclose(got[got.component == 2].explained, explained[1])
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.5, -2.0]) for i in range(50)]):
        df = whitening.op12(frame(spark, rows))
        assert df.count() == 0 and df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_far_from_the_origin_and_ill_conditioned(spark):
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.standard_normal((6, 6)))
    x = rng.standard_normal((400, 6)) * np.array([3e4, 1e3, 100, 10, 3, 1]) @ q + 1e6
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = whitening.op12(frame(spark, rows)).toPandas()
    w, explained, _ = whitened_by_hand(rows, 6)
    for c in range(1, 7):
        mine = got[got.component == c].sort_values("vec_id").whitened.to_numpy()
        assert np.allclose(mine * np.sign(mine @ w[:, c - 1]), w[:, c - 1], atol=1e-5)
    assert got.identity_error[0] < 1e-9


def test_deviations_past_a_long():
    x = np.array([[0, 1 << 40], [5, 7]])
    sums = [int(v) for v in x.sum(axis=0)]
    assert whitening.deviations(x, 2, sums).to_pylist() == [None, None]
    near = np.array([[3, 4], [6, 9]])
    assert whitening.deviations(near, 2, [9, 13]).to_pylist() == [34, 34]
    assert whitening.deviations(np.zeros((0, 2), np.int64), 2, [9, 13]).to_pylist() == []


# ---------------------------------------------------------------- centroid clustering

def clusters_by_hand(rows, k, rounds, dim):
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows
            if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) and abs(c) < 2 ** 19 for c in v)]
    named = sorted(((hashlib.sha256(f"2:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None))[:k]
    centres = [x for _, x in named]
    dist = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    near = lambda x: min((dist(x, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        for j in range(len(centres)):
            mine = [x for (_, x), o in zip(kept, own) if o == j]
            if mine:
                centres[j] = [sum(col) // len(mine) for col in zip(*mine)]
    return [(i, near(x)[1], near(x)[0]) for i, x in kept], centres


def grid_vectors(dim, n, seed=4):
    """Coarse coordinates: many equal distances, and a hot vector."""
    rng = random.Random(seed)
    rows = [(i, [rng.randrange(-3, 4) / 256 for _ in range(dim)]) for i in range(n)] + [(n + i, [2 / 256] * dim) for i in range(n // 3)]
    rows += [rows[1], (1, rows[-1][1]), (None, rows[0][1])]
    bad = [(7000, None), (7001, [None] * dim), (7002, [math.nan] * dim), (7003, [-math.inf] * dim), (7004, [1.0] * (dim + 1)), (7005, []), (7006, [1e30] * dim)]
    return rows + bad


@pytest.mark.parametrize("dim,n,k", [(2, 300, 12), (4, 300, 40), (64, 120, 40), (3, 5, 40), (3, 30, 1)])
def test_clusters(spark, dim, n, k):
    rows = grid_vectors(dim, n)
    found, centres = centroids.cluster(frame(spark, rows), dim=dim, k=k)
    want, last = clusters_by_hand(rows, k, 5, dim)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(want, key=key)
    assert centres.tolist() == last


def test_cluster_query(spark, tmp_path):
    rows = grid_vectors(64, 90)
    df = frame(spark, rows)
    df.write.parquet(f"{tmp_path}/e")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    ok, msg = compare(centroids.op13(df), con, centroids.SQL)
    assert ok, msg
    empty = centroids.op13(frame(spark, rows[-7:]))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_bounds_spare_searches():
    """Clustered vectors: after the first round most rows keep their centroid without any search."""
    rng = np.random.default_rng(0)
    middle = rng.integers(-4000, 4000, (20, 8))
    x = (middle[rng.integers(0, 20, 4000)] + rng.integers(-40, 40, (4000, 8))).astype(np.int64)
    centres = x[rng.permutation(len(x))[:20]].copy()
    near, second = np.zeros(len(x), np.int32), np.ones(len(x), np.int32)
    upper, lower, searched = np.full(len(x), np.inf), np.zeros(len(x)), []
    for _ in range(6):
        searched.append(centroids.assign(x, centres, centroids.Neighbours(centres), near, second, upper, lower))
        d = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
        assert (near == d.argmin(axis=1)).all() and (d[np.arange(len(x)), near] <= (upper * (1 + 1e-8)) ** 2).all()
        new = np.array([x[near == c].sum(axis=0) // max(1, (near == c).sum()) if (near == c).any() else centres[c] for c in range(20)])
        centroids.moved(near, upper, lower, np.sqrt(((new - centres) ** 2).sum(axis=1).astype(float)))
        centres = new
    assert searched[0] == len(x) and sum(searched[2:]) < 0.2 * 4 * len(x)
