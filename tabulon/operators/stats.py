"""Statistics and chart-ready aggregates.

Column statistics of all columns are fused into one aggregate; histograms
and value counts unpivot the columns and aggregate once, with partial
aggregation before the shuffle (a few rows per column and task leave each
task, whatever the data size or skew).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.numeric import data_columns, numeric_columns, q, string_columns
from tabulon.operators.moments import pair_moments
from tabulon.operators.quantiles import quantiles


def _rounder(digits: int | None, half_even: bool):
    if digits is None:
        return lambda c: c
    return (lambda c: F.bround(c, digits)) if half_even else (lambda c: F.round(c, digits))


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# Sums of doubles depend on the order rows are added in; the part of each value that a wide decimal holds is
# summed exactly, and what is left of it (under 1e-10, or the whole of a huge or infinite value) as doubles.
_EXACT_SUM = "decimal(38,10)"


def _sum(v):
    held = F.when(F.abs(v) < 1e15, v).try_cast(_EXACT_SUM)
    return F.coalesce(F.try_sum(held).cast("double"), F.when(F.count(v) > 0, 0.0)) + F.sum(v - F.coalesce(held.cast("double"), F.lit(0.0)))


def column_summary(df: DataFrame, cols: list[str] | None = None, digits: int | None = 4,
                   with_median: bool = True, half_even: bool = True) -> DataFrame:
    """A1: min, max, mean, median, std (sample), sum, count and missing % per numeric column.

    One aggregate for all columns plus the exact distributed medians; the
    one-row result is unpivoted with ``stack``.
    """
    cols = cols if cols is not None else numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, min double, max double, mean double, "
                                                    "median double, std double, sum double, count bigint, "
                                                    "missing_pct double")
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        v = q(c).cast("double")
        aggs += [F.min(v).alias(f"mn{i}"), F.max(v).alias(f"mx{i}"), F.avg(v).alias(f"av{i}"),
                 F.stddev_samp(v).alias(f"sd{i}"), _sum(v).alias(f"su{i}"), F.count(v).alias(f"n{i}")]
    row = df.agg(*aggs)
    meds = quantiles(df, cols, [0.5]) if with_median else {c: [None] for c in cols}
    r = _rounder(digits, half_even)
    parts = ", ".join(
        f"{_sql_str(c)}, mn{i}, mx{i}, av{i}, CAST({'NULL' if meds[c][0] is None else repr(str(float(meds[c][0])))} AS DOUBLE), "
        f"sd{i}, su{i}, n{i}" for i, c in enumerate(cols))
    long = row.selectExpr(
        f"stack({len(cols)}, {parts}) AS (column, min, max, mean, median, std, sum, count)", "_rows")
    return long.select(
        "column", r(F.col("min")).alias("min"), r(F.col("max")).alias("max"), r(F.col("mean")).alias("mean"),
        r(F.col("median")).alias("median"), r(F.col("std")).alias("std"),
        r(F.col("sum")).cast("double").alias("sum"),
        F.col("count"),
        F.bround(F.try_divide(F.col("_rows") - F.col("count"), F.col("_rows")) * 100, 2).alias("missing_pct"))


def histogram(df: DataFrame, cols: list[str] | None = None, bins: int = 20, max_cols: int | None = None,
              edge_digits: int = 2) -> DataFrame:
    """A2: equal-width bins over [min, max] (last bin closed), zero bins included.

    ``(column, bin, left_edge, count)``; a constant column gets the range
    min-0.5 .. max+0.5, like numpy.
    """
    cols = (cols if cols is not None else numeric_columns(df))[:max_cols]
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column string, bin int, left_edge double, count bigint")
    mm = df.agg(*[x for i, c in enumerate(cols)
                  for x in (F.min(q(c).cast("double")).alias(f"a{i}"), F.max(q(c).cast("double")).alias(f"b{i}"))]).first()
    ranges = {}
    for i, c in enumerate(cols):
        lo, hi = mm[f"a{i}"], mm[f"b{i}"]
        if lo is None:
            continue
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        ranges[c] = (lo, hi)
    if not ranges:
        return spark.createDataFrame([], "column string, bin int, left_edge double, count bigint")
    arms = []
    for c, (lo, hi) in ranges.items():
        v = q(c).cast("double")
        idx = F.floor((v - F.lit(lo)) * (F.lit(float(bins)) / (F.lit(hi) - F.lit(lo)))).cast("int")
        # least() skips nulls, so a null value must not reach it
        arms.append(F.struct(F.lit(c).alias("column"), F.when(v.isNotNull(), F.least(idx, F.lit(bins - 1))).alias("bin")))
    binned = (df.select(F.inline(F.array(*arms)))
                .where(F.col("bin").isNotNull())
                .groupBy("column", "bin").agg(F.count(F.lit(1)).alias("count")))
    grid = spark.createDataFrame(
        [(c, b, lo, (hi - lo) / bins) for c, (lo, hi) in ranges.items() for b in range(bins)],
        "column string, bin int, lo double, step double").select(
        "column", "bin", F.bround(F.col("lo") + F.col("bin") * F.col("step"), edge_digits).alias("left_edge"))
    # The grid is columns x bins rows, known on the driver: broadcast is bounded.
    return (binned.join(F.broadcast(grid), ["column", "bin"], "right")
                  .select("column", "bin", "left_edge", F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def value_counts(df: DataFrame, cols: list[str], k: int = 10) -> DataFrame:
    """A3: top ``k`` values per column by count (nulls excluded; ties by value).

    ``row_number() <= k`` lets Spark insert a partial per-task group limit
    before the shuffle, so at most ``k`` rows per column leave each task.
    """
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value string, count bigint, rank int")
    arms = [F.struct(F.lit(c).alias("column"), q(c).cast("string").alias("value")) for c in cols]
    counts = (df.select(F.inline(F.array(*arms))).where(F.col("value").isNotNull())
                .groupBy("column", "value").agg(F.count(F.lit(1)).alias("count")))
    w = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: A spread below this share of the mean square is rounding: the column is constant on the rows of the pair.
FLAT = 1e-13


def corr_matrix(df: DataFrame, cols: list[str] | None = None, max_cols: int | None = None, digits: int | None = 3
                ) -> DataFrame:
    """A4/V4: pairwise-complete Pearson correlation, long form ``(col_a, col_b, corr)``.

    From the pair moments of all columns (`moments.py`): a pass for the means, a pass for the products, whatever the
    number of columns.  A column that is constant where the other one is present has no correlation (null).
    """
    cols = (cols if cols is not None else numeric_columns(df))[:max_cols]
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, corr double")
    n = F.col("n")
    vx, vy = F.col("xx") - F.try_divide(F.col("x") * F.col("x"), n), F.col("yy") - F.try_divide(F.col("y") * F.col("y"), n)
    flat = (n == 0) | (vx <= F.col("xx") * FLAT) | (vy <= F.col("yy") * FLAT)
    ratio = F.try_divide(F.col("xy") - F.try_divide(F.col("x") * F.col("y"), n), F.sqrt(F.when(~flat, vx)) * F.sqrt(F.when(~flat, vy)))
    corr = F.when(F.col("i") == F.col("j"), F.when(~flat, F.lit(1.0))).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio)))
    corr = F.when(~flat, corr)
    names = F.array(*[F.lit(c) for c in cols])
    pairs = pair_moments(df, cols).select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"),
                                          (F.bround(corr, digits) if digits is not None else corr).alias("corr"))
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(
        F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return pairs.select(F.inline(both).alias("col_a", "col_b"), "corr")


def group_top_k(df: DataFrame, cat: str, value: str, k: int = 8, digits: int | None = 2) -> DataFrame:
    """A5: sum of ``value`` by ``cat``, top ``k`` (null groups dropped; ties by category)."""
    total = F.sum(q(value))
    g = df.where(q(cat).isNotNull()).groupBy(q(cat).alias(cat)).agg(total.alias("total"))
    if digits is not None:
        g = g.select(cat, F.bround("total", digits).alias("total"))
    return g.orderBy(F.desc("total"), q(cat)).limit(k)


def trend(df: DataFrame, date: str, value: str, digits: int | None = 2) -> DataFrame:
    """Sum of ``value`` per date, ascending, null dates dropped."""
    g = df.where(q(date).isNotNull()).groupBy(q(date).alias(date)).agg(F.sum(q(value)).alias("total"))
    if digits is not None:
        g = g.select(date, F.bround("total", digits).alias("total"))
    return g.orderBy(q(date))


def kpis(df: DataFrame, rev: str | None, cost: str | None, digits: int | None = None) -> DataFrame:
    """Record count, column count, total revenue and net profit (nulls as 0), long form."""
    ncols = len(data_columns(df))
    aggs = [F.count(F.lit(1)).cast("double").alias("k_records"), F.lit(float(ncols)).alias("k_columns")]
    names = ["'Total Records', k_records", "'Columns', k_columns"]
    if rev:
        r = F.coalesce(q(rev).try_cast("double"), F.lit(0.0))
        aggs.append(F.sum(r).alias("k_rev"))
        names.append("'Total Revenue', k_rev")
        if cost:
            c = F.coalesce(q(cost).try_cast("double"), F.lit(0.0))
            aggs.append((F.sum(r) - F.sum(c)).alias("k_profit"))
            names.append("'Net Profit', k_profit")
    out = df.agg(*aggs).selectExpr(f"stack({len(names)}, {', '.join(names)}) AS (kpi, value)")
    if digits is not None:
        out = out.select("kpi", F.bround("value", digits).alias("value"))
    return out


# ------------------------------------------------------------------ chart data (V1-V6)

def _first(cols: list[str]) -> str | None:
    return cols[0] if cols else None


def bar_data(df: DataFrame) -> DataFrame:
    """V1: first text column x first numeric column, summed per category."""
    cat, num = _first(string_columns(df)), _first(numeric_columns(df))
    if not (cat and num):
        return df.sparkSession.createDataFrame([], "category string, value double")
    return df.groupBy(q(cat).alias("category")).agg(F.sum(q(num)).alias("value"))


def pie_data(df: DataFrame) -> DataFrame:
    """V2: row count per value of the first text column."""
    cat = _first(string_columns(df))
    if not cat:
        return df.sparkSession.createDataFrame([], "category string, count bigint")
    return df.groupBy(q(cat).alias("category")).agg(F.count(F.lit(1)).alias("count"))


def xy_data(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """V3/V5: the first two numeric columns as (x, y); V3 (line) passes ``order_by``."""
    nums = numeric_columns(df)
    if len(nums) < 2:
        return df.sparkSession.createDataFrame([], "x double, y double")
    out = df.select(q(nums[0]).alias("x"), q(nums[1]).alias("y"), *[q(c) for c in (order_by or [])])
    if order_by:
        out = out.orderBy(*[q(c) for c in order_by]).select("x", "y")
    return out


def box_data(df: DataFrame, col: str | None = None) -> DataFrame:
    """V6: five-number summary and 1.5 IQR fences of the first numeric column."""
    col = col or _first(numeric_columns(df))
    spark = df.sparkSession
    schema = ("column string, min double, q1 double, median double, q3 double, max double, "
              "lower_fence double, upper_fence double, n_outliers bigint")
    if not col:
        return spark.createDataFrame([], schema)
    mn, q1, med, q3, mx = quantiles(df, [col], [0.0, 0.25, 0.5, 0.75, 1.0])[col]
    if q1 is None:
        return spark.createDataFrame([(col, None, None, None, None, None, None, None, 0)], schema)
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    v = q(col).cast("double")
    return df.agg(F.count_if((v < F.lit(lo)) | (v > F.lit(hi))).alias("n_outliers")).select(
        F.lit(col).alias("column"), F.lit(mn).alias("min"), F.lit(q1).alias("q1"), F.lit(med).alias("median"),
        F.lit(q3).alias("q3"), F.lit(mx).alias("max"), F.lit(lo).alias("lower_fence"),
        F.lit(hi).alias("upper_fence"), "n_outliers")
