"""Cleaning: duplicates, sparse/constant columns, imputation, outlier fences.

Statistics that steer a step (medians, modes, fences) are computed with
distributed aggregates and applied as literals, so each step is a narrow
projection or filter over the input; no step gathers a column in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.numeric import INTEGRAL_TYPES, ROW_ID, data_columns, numeric_columns, q, to_number
from tabulon.operators.distinct import constant_columns
from tabulon.operators.ordering import forward_fill
from tabulon.operators.profile import ColumnProfile, StepLog
from tabulon.operators.quantiles import quantiles, quantiles_and_counts, stable_input


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Exact duplicate rows, nulls equal (partial aggregation collapses hot rows per task).

    Row ids don't make rows different: of equal rows the first one's id stays.
    """
    if ROW_ID not in df.columns:
        return df.dropDuplicates()
    return df.groupBy(*[q(c) for c in data_columns(df)]).agg(F.min(ROW_ID).alias(ROW_ID)).select(*[q(c) for c in df.columns])


def drop_zero_variance(df: DataFrame, profiles: list[ColumnProfile] | None = None) -> tuple[DataFrame, list[str]]:
    """Drop columns with at most one distinct non-null value."""
    if profiles is None:
        cols = constant_columns(df, data_columns(df))
    else:
        cols = [p.column for p in profiles if p.n_distinct <= 1 and p.column in df.columns]
    return df.drop(*cols), cols


def drop_sparse(df: DataFrame, threshold: float = 70.0, profiles: list[ColumnProfile] | None = None
                ) -> tuple[DataFrame, list[str]]:
    """Drop columns whose missing share (in %, rounded to 1 dp) is above ``threshold``."""
    if profiles is None:
        row = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(q(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
        rows = row["_rows"]
        miss = {c: rows - row[f"n{i}"] for i, c in enumerate(df.columns)}
    else:
        rows = profiles[0].rows if profiles else 0
        miss = {p.column: p.n_missing for p in profiles}
    cols = [c for c in df.columns if rows and miss.get(c, 0) > 0 and round(miss[c] / rows * 100, 1) > threshold]
    return df.drop(*cols), cols


def column_modes(df: DataFrame, cols: list[str]) -> dict[str, object]:
    """Most frequent non-null value per column, ties to the smallest; None when all null.

    One job for all columns: values are unpivoted, counted with partial
    aggregation per task, and the top-1 per column is a group limit applied
    before the shuffle, so no task ever holds all values of a column.  Modes
    fill text, date and boolean columns, whose text forms sort like the values.
    """
    if not cols:
        return {}
    from tabulon.operators.stats import value_counts
    top = {r["column"]: r["value"] for r in value_counts(df, cols, 1).collect()}
    # Values come back as text; the fill casts them to the column type in the plan.
    return {c: top.get(c) for c in cols}


def _with_nulls(df: DataFrame, cols: list[str]) -> list[str]:
    row = df.agg(*[F.count_if(q(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[f"m{i}"] > 0]


def fill_median(df: DataFrame, cols: list[str] | None = None, have_nulls: bool = False
                ) -> tuple[DataFrame, dict[str, float]]:
    """C4: fill numeric nulls with the exact column median.

    Integral columns with nulls become double first: a median may be x.5.
    All-null columns are left alone (their median is undefined).
    ``have_nulls``: the caller already knows every column in ``cols`` has nulls.
    """
    cols = cols if cols is not None else numeric_columns(df)
    if not cols:
        return df, {}
    need = cols if have_nulls else _with_nulls(df, cols)
    med = {c: v[0] for c, v in (quantiles(df, need, [0.5]).items() if need else []) if v[0] is not None}
    return _fill(df, med, as_double=True), med


def fill_mean(df: DataFrame, cols: list[str] | None = None) -> tuple[DataFrame, dict[str, float]]:
    """Fill numeric nulls with the column mean."""
    cols = cols if cols is not None else numeric_columns(df)
    if not cols:
        return df, {}
    row = df.agg(*[F.avg(q(c)).alias(f"a{i}") for i, c in enumerate(cols)],
                 *[F.count_if(q(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    means = {c: row[f"a{i}"] for i, c in enumerate(cols) if row[f"a{i}"] is not None and row[f"m{i}"] > 0}
    return _fill(df, means, as_double=True), means


def fill_constant(df: DataFrame, value=0, cols: list[str] | None = None) -> DataFrame:
    """Fill nulls with a constant (numeric columns by default)."""
    cols = cols if cols is not None else numeric_columns(df)
    return _fill(df, {c: value for c in cols})


def _fill(df: DataFrame, values: dict[str, object], as_double: bool = False) -> DataFrame:
    """Coalesce each named column with its fill value.

    ``as_double`` (statistic fills): a filled integral column becomes double,
    as a pandas integer column holding NaN already is.
    """
    out = []
    for f in df.schema.fields:
        v = values.get(f.name)
        if v is None:
            out.append(q(f.name))
            continue
        col = q(f.name)
        dtype = f.dataType
        if as_double and isinstance(dtype, INTEGRAL_TYPES):
            col, dtype = col.cast("double"), T.DoubleType()
        out.append(F.coalesce(col, F.lit(v).cast(dtype)).alias(f.name))
    return df.select(*out)


def fill_mode(df: DataFrame, cols: list[str] | None = None, unknown: str = "Unknown",
              have_nulls: bool = False) -> tuple[DataFrame, dict[str, object]]:
    """Fill nulls with the mode (ties to the smallest), ``'Unknown'`` when a text column has no value."""
    num = set(numeric_columns(df))
    cols = cols if cols is not None else [c for c in df.columns if c not in num]
    if not cols:
        return df, {}
    need = cols if have_nulls else _with_nulls(df, cols)
    modes = column_modes(df, need)
    string_cols = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    for c, v in list(modes.items()):
        if v is None:
            modes[c] = unknown if c in string_cols else None
    return _fill(df, modes), modes


def impute_basic(df: DataFrame) -> tuple[DataFrame, dict[str, object]]:
    """C4 + C5 as the analyst/BI/SQL flavours do it: numeric by median, the rest by mode.

    One pass finds the columns with nulls for both steps.
    """
    need = set(_with_nulls(df, df.columns)) if df.columns else set()
    num = set(numeric_columns(df))
    df1, med = fill_median(df, [c for c in df.columns if c in num and c in need], have_nulls=True)
    df2, modes = fill_mode(df1, [c for c in df.columns if c not in num and c in need], have_nulls=True)
    return df2, {**med, **modes}


def smart_impute(df: DataFrame, types: dict[str, str], order_by=None, log: StepLog | None = None,
                 profiles: list[ColumnProfile] | None = None) -> DataFrame:
    """ETL flavour (C3 -> C4/C6/C5): drop columns >70 % missing; numeric-like by median,
    datetime by forward fill in ``order_by`` order, others by mode."""
    row = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(q(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)]).first()
    missing = {c: row[f"m{i}"] for i, c in enumerate(df.columns)}
    rows = row["_rows"]
    dropped = [c for c in df.columns
               if rows and missing[c] > 0 and round(missing[c] / rows * 100, 1) > 70.0]
    df = df.drop(*dropped)
    for c in dropped:
        log and log.add("TRANSFORM", "drop_sparse_column", c)
    todo = [c for c in df.columns if missing[c] > 0 and c in types]
    med_cols = [c for c in todo if types[c] in ("numeric", "binary", "categorical_num")]
    dt_cols = [c for c in todo if types[c] == "datetime"]
    mode_cols = [c for c in todo if c not in med_cols and c not in dt_cols]
    df, _ = fill_median(df, med_cols, have_nulls=True)
    if dt_cols:
        if order_by is None:
            raise ValueError("forward fill of datetime columns needs order_by")
        df = forward_fill(df, dt_cols, order_by)
    df, _ = fill_mode(df, mode_cols, have_nulls=True)
    if log:
        for c in med_cols:
            log.add("TRANSFORM", "fill_median", c, missing[c])
        for c in dt_cols:
            log.add("TRANSFORM", "forward_fill", c, missing[c])
        for c in mode_cols:
            log.add("TRANSFORM", "fill_mode", c, missing[c])
    return df


@dataclass
class FenceResult:
    frame: DataFrame
    removed: dict[str, int] = field(default_factory=dict)
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)


def quantile_filter(df: DataFrame, cols: list[str] | None = None, lo_p: float = 0.25, hi_p: float = 0.75,
                    k: float = 1.5, only_if_outliers: bool = True, mode: str = "sequential",
                    exact: bool = True) -> FenceResult:
    """Keep rows inside ``[q_lo - k*(q_hi-q_lo), q_hi + k*(q_hi-q_lo)]`` (inclusive).

    ``sequential`` (the reference's semantics): column by column, quantiles of
    the rows left so far.  With ``only_if_outliers`` (Tukey/C7) a column
    without outliers filters nothing (its nulls stay); otherwise (wide fence,
    C8) the filter always applies and a null fails it.  ``simultaneous``
    computes all fences on the input in one pass (a documented, different
    result).  ``exact=False`` uses one-pass sketch quantiles (opt-in).
    All-null columns are skipped.
    """
    cols = cols if cols is not None else numeric_columns(df)
    base = stable_input(df, df.columns)
    res = FenceResult(base)
    probs = [lo_p, hi_p]
    if mode == "simultaneous":
        qs = quantiles(base, cols, probs, exact=exact)
        cur = base
        for c in cols:
            if qs[c][0] is None:
                continue
            lo, hi = _fence(qs[c], k)
            res.bounds[c] = (lo, hi)
            res.removed[c] = cur.agg(F.count_if(~_inside(c, lo, hi)).alias("n")).first()["n"]
            cur = cur.where(_inside(c, lo, hi)) if (res.removed[c] or not only_if_outliers) else cur
        res.frame = cur
        return res
    # Sequential: the first pass of column i+1 also counts the rows left after
    # the fence of column i, so that count needs no pass of its own.
    cur = base
    info = quantiles_and_counts(cur, cols[:1], probs, exact, stable=False) if cols else None
    for i, c in enumerate(cols):
        qv, nonnull, rows = info[0][c], info[1][c], info[2]
        nxt_col = cols[i + 1:i + 2]
        if qv[0] is None:
            info = quantiles_and_counts(cur, nxt_col, probs, exact, stable=False) if nxt_col else None
            continue
        lo, hi = _fence(qv, k)
        res.bounds[c] = (lo, hi)
        filtered = cur.where(_inside(c, lo, hi))
        if only_if_outliers and nonnull < rows:
            # Nulls present: rows outside the fence are not the rows a filter drops.
            n_out = cur.agg(F.count_if((q(c) < F.lit(lo)) | (q(c) > F.lit(hi))).alias("n")).first()["n"]
            res.removed[c] = n_out
            cur = filtered if n_out else cur
            info = quantiles_and_counts(cur, nxt_col, probs, exact, stable=False) if nxt_col else None
            continue
        if nxt_col:
            info = quantiles_and_counts(filtered, nxt_col, probs, exact, stable=False)
            rows_after = info[2]
        else:
            rows_after = filtered.count()
        res.removed[c] = rows - rows_after
        # Without nulls, "no outliers" means the filter keeps every row: keep the plan short.
        cur = cur if (only_if_outliers and rows_after == rows) else filtered
    res.frame = cur
    return res


def _fence(qv, k):
    a, b = qv
    return a - k * (b - a), b + k * (b - a)


def _inside(c: str, lo: float, hi: float):
    return (q(c) >= F.lit(lo)) & (q(c) <= F.lit(hi))


def tukey_filter(df: DataFrame, cols: list[str] | None = None, mode: str = "sequential",
                 exact: bool = True) -> FenceResult:
    """1.5 IQR fences on quartiles, only columns with outliers filter."""
    return quantile_filter(df, cols, 0.25, 0.75, 1.5, only_if_outliers=True, mode=mode, exact=exact)


def wide_fence_filter(df: DataFrame, cols: list[str] | None = None, mode: str = "sequential",
                      exact: bool = True) -> FenceResult:
    """3x (q99 - q1) fences on the 1st/99th percentiles; nulls fail."""
    return quantile_filter(df, cols, 0.01, 0.99, 3.0, only_if_outliers=False, mode=mode, exact=exact)


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Text to double, unparsable values become null."""
    return df.select(*[(to_number(c, df.schema[c].dataType).alias(c) if c in cols else q(c)) for c in df.columns])


def drop_incomplete(df: DataFrame) -> DataFrame:
    """C11: drop rows with any null."""
    return df.na.drop(how="any")
