"""Exact quantiles without sending a column to one task.

Spark's exact ``percentile``/``median`` aggregate merges every distinct value
of a column into a single buffer in one task; on a 100 TB column that task
never finishes.  Here the k-th smallest value is found by narrowing an open
interval around the wanted rank:

1. one job, all columns fused: counts, ends and, for each wanted quantile,
   two pivots around its rank from ``percentile_approx`` (a mergeable sketch of
   proven rank error, bounded memory per task); neighbouring ranks share them;
2. strictly between two pivots lie at most SPAN of all rows.  Where that is few,
   one more job counts the rows below and at the pivots and fetches the values
   between them: order statistics take two scans, however many columns;
3. else the next job counts exactly how many values lie below, at, between and
   above the pivots and draws a finer grid between them.  A rank that falls on a
   pivot is found, however many rows hold that value; otherwise the interval
   shrinks to the side that holds the rank and never widens again;
4. once an interval holds few values by exact count, their value counts are
   fetched and the order statistic is read off.

Every job is one scan of the needed columns for all open intervals.  A pivot that
misses the rank costs a further round, never a wrong result.  NaN counts as missing, infinite
values count.  Interpolation is the linear rule used by pandas/numpy (and
DuckDB ``quantile_cont``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.numeric import q

GRID = 256                # grid points per interval and pass
ACCURACY = 10000          # percentile_approx accuracy (relative rank error 1/ACCURACY)
COLLECT_LIMIT = 20000     # most values fetched for all intervals together (GRID for each at least)
MARGIN = 2.0 / ACCURACY   # how far from a wanted rank its first pivots are drawn: twice the error of a point
SPAN = 2 * MARGIN + 2.0 / ACCURACY   # so this share of the rows, at most, lies strictly between them


@dataclass
class _Target:
    """A wanted order statistic: rank ``r`` among the ``inside`` values strictly between ``lo`` and ``hi``."""
    col: str
    k: int                # 0-based rank in the column
    r: int
    inside: int
    grid: list[float] | None
    lo: float | None = None       # None: unbounded
    hi: float | None = None
    value: float | None = None
    first: tuple[float, float] | None = None      # the pivots drawn with the first scan

    def pivots(self) -> tuple[float | None, float | None]:
        if self.first:
            return self.first
        if self.grid is None:
            return None, None
        margin = 2.0 / ACCURACY + 1.0 / GRID
        p = self.r / max(self.inside - 1, 1)
        i, j = math.floor((p - margin) * GRID), math.ceil((p + margin) * GRID)
        return float(self.grid[max(0, i)]), float(self.grid[min(GRID, j)])


def _v(col: str):
    """The column as double, NaN as null."""
    v = q(col).cast("double")
    return F.when(~F.isnan(v), v)


def _between(col: str, lo: float | None, hi: float | None):
    v, cond = q(col).cast("double"), _v(col).isNotNull()
    if lo is not None:
        cond &= v > F.lit(lo)
    if hi is not None:
        cond &= v < F.lit(hi)
    return cond


def _grid(c: str, cond=None):
    v = _v(c)
    return F.percentile_approx(v if cond is None else F.when(cond, v), [i / GRID for i in range(GRID + 1)], ACCURACY)


def kth_values(df: DataFrame, wanted: dict[str, dict[int, tuple[float, float]]], counts: dict[str, int]
               ) -> dict[tuple[str, int], float]:
    """Exact k-th smallest value for each (column, k), given the pivots around it."""
    targets = [_Target(c, k, k, counts[c], None, first=ends) for c, ks in wanted.items() for k, ends in sorted(ks.items())]
    if targets and sum(SPAN * counts[c] + 2 for c, _ in {(t.col, t.first) for t in targets}) <= COLLECT_LIMIT:
        _count_and_fetch(df, targets)
    while todo := [t for t in targets if t.value is None]:
        few = max(GRID, COLLECT_LIMIT // len({(t.col, t.lo, t.hi) for t in todo}))
        small = [t for t in todo if t.inside <= few]
        if small:
            _fetch(df, small)
        else:
            _narrow(df, todo)
    return {(t.col, t.k): t.value for t in targets}


def _count_and_fetch(df: DataFrame, targets: list[_Target]) -> None:
    """One job: rows below and at the first pivots, and the values strictly between them.

    The sketch's error bounds how many those are, also beside a hot value: one that lies strictly between two pivots
    can't hold more rows than they enclose.  A rank outside its pivots stays open for the narrowing rounds.
    """
    groups: dict[tuple, list[_Target]] = {}
    for t in targets:
        groups.setdefault((t.col, *t.first), []).append(t)
    aggs = []
    for i, (col, a, b) in enumerate(groups):
        v = _v(col)
        aggs += [F.count_if(_between(col, None, a)).alias(f"below{i}"), F.count_if(v == F.lit(a)).alias(f"a{i}"),
                 F.collect_list(F.when(_between(col, a, b), v)).alias(f"mid{i}"), F.count_if(v == F.lit(b)).alias(f"b{i}")]
    row = df.agg(*aggs).first()
    for i, ((_, a, b), members) in enumerate(groups.items()):
        below, at_a, mid, at_b = row[f"below{i}"], row[f"a{i}"], sorted(row[f"mid{i}"]), row[f"b{i}"] if b > a else 0
        for t in members:
            r = t.r - below
            if 0 <= r < at_a:
                t.value = a
            elif at_a <= r < at_a + len(mid):
                t.value = mid[r - at_a]
            elif at_a + len(mid) <= r < at_a + len(mid) + at_b:
                t.value = b
            t.first = None


def _narrow(df: DataFrame, targets: list[_Target]) -> None:
    """One job over all open intervals: exact counts around the pivots and a finer grid between them."""
    groups: dict[tuple, list[_Target]] = {}
    for t in targets:
        groups.setdefault((t.col, t.lo, t.hi, *t.pivots()), []).append(t)
    aggs = []
    for i, (col, lo, hi, a, b) in enumerate(groups):
        if a is None:
            aggs.append(_grid(col, _between(col, lo, hi)).alias(f"g{i}"))
            continue
        v = _v(col)
        aggs += [F.count_if(_between(col, lo, a)).alias(f"below{i}"), F.count_if(v == F.lit(a)).alias(f"a{i}"),
                 F.count_if(_between(col, a, b)).alias(f"mid{i}"), F.count_if(v == F.lit(b)).alias(f"b{i}"),
                 _grid(col, _between(col, a, b)).alias(f"g{i}")]
    row = df.agg(*aggs).first()
    for i, ((_, _, _, a, b), members) in enumerate(groups.items()):
        grid = row[f"g{i}"]
        for t in members:
            t.first = None
            if a is None:
                t.grid = grid
                continue
            below, at_a, mid = row[f"below{i}"], row[f"a{i}"], row[f"mid{i}"]
            at_b = row[f"b{i}"] if b > a else 0
            if t.r < below:                                    # the grid missed the rank: go on below it
                t.hi, t.inside, t.grid = a, below, None
            elif t.r < below + at_a:
                t.value = a
            elif t.r < below + at_a + mid:
                t.lo, t.hi, t.r, t.inside, t.grid = a, b, t.r - below - at_a, mid, grid
            elif t.r < below + at_a + mid + at_b:
                t.value = b
            else:                                              # or above it
                past = below + at_a + mid + at_b
                t.lo, t.r, t.inside, t.grid = b, t.r - past, t.inside - past, None


def _fetch(df: DataFrame, targets: list[_Target]) -> None:
    """Resolve small intervals from their value counts: one scan and one shuffle for all of them.

    The number of values in each is known exactly, so what leaves the tasks is bounded.
    """
    groups: dict[tuple, list[_Target]] = {}
    for t in targets:
        groups.setdefault((t.col, t.lo, t.hi), []).append(t)
    inside = [_between(*key) for key in groups]
    values = [F.when(cond, F.struct(F.lit(i).alias("b"), _v(key[0]).alias("v")))
              for i, (cond, key) in enumerate(zip(inside, groups))]
    rows = (df.where(reduce(lambda x, y: x | y, inside)).select(F.inline(F.array_compact(F.array(*values))))
              .groupBy("b", "v").count().collect())
    for i, members in enumerate(groups.values()):
        counted = sorted((r["v"], r["count"]) for r in rows if r["b"] == i)
        for t in members:
            seen = 0
            for v, n in counted:
                seen += n
                if t.r < seen:
                    t.value = v
                    break
            else:
                raise ValueError(f"the input changed between two passes over {t.col}")


def stable_input(df: DataFrame, cols: list[str]) -> DataFrame:
    """Project to ``cols``; if producing them needs a shuffle (joins, dedup), write
    the projection once to the checkpoint dir so the passes do not redo it."""
    proj = df.select(*[q(c) for c in cols])
    try:
        plan = proj._jdf.queryExecution().executedPlan().toString()
    except Exception:  # no JVM handle: assume the input is expensive
        plan = "Exchange"
    if "Exchange" in plan:
        from tabulon.session import materialize
        return materialize(proj)
    return proj


def quantiles(df: DataFrame, cols: list[str], probs: list[float], exact: bool = True,
              accuracy: int = ACCURACY) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles per column (None for an all-null column).

    ``exact=False`` is the opt-in one-pass sketch (``percentile_approx``:
    rank error at most 1/accuracy, values taken from the data, no
    interpolation).
    """
    return quantiles_and_counts(df, cols, probs, exact, accuracy)[0]


def quantiles_and_counts(df: DataFrame, cols: list[str], probs: list[float], exact: bool = True,
                         accuracy: int = ACCURACY, stable: bool = True
                         ) -> tuple[dict[str, list[float | None]], dict[str, int], int]:
    """Quantiles plus, from the same first pass, counts of values (neither null nor NaN) per column and the row count."""
    if not cols:
        return {}, {}, df.count()
    if not exact:
        row = df.agg(F.count(F.lit(1)).alias("_rows"),
                     *[F.count(_v(c)).alias(f"n{i}") for i, c in enumerate(cols)],
                     *[F.percentile_approx(_v(c), list(probs), accuracy).alias(f"p{i}")
                       for i, c in enumerate(cols)]).first()
        out = {c: (list(row[f"p{i}"]) if row[f"p{i}"] is not None else [None] * len(probs))
               for i, c in enumerate(cols)}
        return out, {c: row[f"n{i}"] for i, c in enumerate(cols)}, row["_rows"]
    if stable:
        df = stable_input(df, cols)
    row = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[x for i, c in enumerate(cols) for x in (F.count(_v(c)).alias(f"n{i}"), F.min(_v(c)).alias(f"mn{i}"),
                                                           F.max(_v(c)).alias(f"mx{i}"))],
                 *[F.percentile_approx(_v(c), [x for p in probs for x in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))], ACCURACY)
                   .alias(f"g{i}") for i, c in enumerate(cols)]).first()
    counts = {c: row[f"n{i}"] for i, c in enumerate(cols)}
    wanted: dict[str, dict[int, tuple[float, float]]] = {}
    for i, c in enumerate(cols):
        n = counts[c]
        for j, p in enumerate(probs if n else []):
            lo = math.floor((n - 1) * p)
            ends = (float(row[f"g{i}"][2 * j]), float(row[f"g{i}"][2 * j + 1]))
            wanted.setdefault(c, {}).update((k, ends) for k in (lo, min(lo + 1, n - 1)) if 0 < k < n - 1)
    kv = kth_values(df, wanted, counts)
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        n, res = counts[c], []
        kv |= {(c, n - 1): row[f"mx{i}"], (c, 0): row[f"mn{i}"]}
        for p in probs:
            if n == 0:
                res.append(None)
                continue
            h = (n - 1) * p
            lo = math.floor(h)
            a, b = kv[(c, lo)], kv[(c, min(lo + 1, n - 1))]
            res.append(a if a == b or h == lo else a + (b - a) * (h - lo))
        out[c] = res
    return out, counts, row["_rows"]
