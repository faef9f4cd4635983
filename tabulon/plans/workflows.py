"""The four upload-to-results flows, composed from the operators.

Each takes a DataFrame (any table) and returns a dict of DataFrames and small
driver-side values (roles, logs, scores).  NaN and infinite values become null
on entry; statistics and charts cover all columns.  Order-dependent steps take an
explicit ``order_by``; without one, rows keep the order of the scan: ``_row_id`` of
:func:`read_csv`, or ids added on entry.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.numeric import ROW_ID, data_columns, nan_to_null, numeric_columns, q
from tabulon.functions.roles import detect_roles
from tabulon.operators import clean as C
from tabulon.operators import features as FE
from tabulon.operators import ml
from tabulon.operators import profile as P
from tabulon.operators import stats as S
from tabulon.operators.ordering import preview, scan_order
from tabulon.plans.querypack import run_pack
from tabulon.session import materialize
from tabulon.sources.csv import clean_column_names
from tabulon.sources.sinks import export_pack_sql, save_table, write_csv


def _guarded(model, *args) -> tuple[dict, str | None]:
    """A model that can't be fitted leaves an error, it doesn't end the flow."""
    try:
        return model(*args), None
    except (ValueError, PySparkException, Py4JJavaError) as exc:
        return {}, (str(exc).strip().splitlines() or [type(exc).__name__])[0]


def in_order(df: DataFrame, order_by=None) -> tuple[DataFrame, list[str]]:
    """The frame and the columns that order its rows; without ``order_by`` these are the ids of the scan."""
    if order_by:
        return df, list(order_by)
    return (df if ROW_ID in df.columns else scan_order(df)), [ROW_ID]


# ------------------------------------------------------------------ analyst flavour

def analyst(df: DataFrame, with_model: bool = True) -> dict:
    """C1 -> C4/C5 -> C7 -> P8 (+ M17 forest metrics)."""
    df = nan_to_null(in_order(df)[0])
    rows_before, cols_before = df.count(), len(data_columns(df))
    # Written once: fills, fences and the score all read the deduplicated rows.
    dedup = materialize(C.drop_duplicates(df))
    n_dedup = dedup.count()
    filled, fills = C.impute_basic(dedup)
    fenced = C.tukey_filter(filled)
    cleaned = materialize(fenced.frame)      # read by the score, the model and every chart
    st = cleaned.agg(F.count(F.lit(1)).alias("n"),
                     sum((F.count_if(q(c).isNull()) for c in data_columns(cleaned)), F.lit(0)).alias("m")).first()
    score = P.quality_score(rows_before, rows_before - n_dedup, st["m"], st["n"], len(data_columns(cleaned)))
    metrics, failed = _guarded(ml.analyst_metrics, cleaned) if with_model else ({}, None)
    return {
        "cleaned": cleaned, **({"ml_error": failed} if failed else {}),
        "changes": {"original_shape": [rows_before, cols_before], "duplicates_removed": rows_before - n_dedup,
                    "missing_values": fills, "outliers": {c: n for c, n in fenced.removed.items() if n},
                    "final_shape": [st["n"], len(data_columns(cleaned))], "quality_score": score,
                    "accuracy_metrics": metrics, "accuracy_score": ml.accuracy_score(metrics, score)},
    }


def load(frames: dict[str, DataFrame], out_dir: str, log: P.StepLog, fmt: str = "csv") -> dict[str, str]:
    """LOAD: each frame as a folder under ``out_dir`` (CSV with every field quoted, or a Parquet table), with its row
    count in the log.  A folder that is there already is replaced only by a complete one."""
    paths = {}
    for name, frame in frames.items():
        at = f"{out_dir.rstrip('/')}/{name}"
        paths[name] = write_csv(frame, at, quote_all=True) if fmt == "csv" else save_table(frame, path=at, fmt=fmt)
        log.add("LOAD", f"{fmt}:{at}", n=frame.count())
    return paths


def chart(df: DataFrame, kind: str, order_by=None) -> DataFrame | None:
    """V1-V6 by name: bar, pie, line, heatmap, scatter, box."""
    if kind == "bar":
        return S.bar_data(df)
    if kind == "pie":
        return S.pie_data(df)
    if kind == "line":
        return S.xy_data(*in_order(df, order_by))
    if kind == "heatmap":
        return S.corr_matrix(df, max_cols=len(df.columns), digits=None)
    if kind == "scatter":
        return S.xy_data(df)
    if kind == "box":
        return S.box_data(df)
    return None


# ------------------------------------------------------------------ ETL flavour

def etl_clean(df: DataFrame, order_by=None, log: P.StepLog | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Type -> dedup -> zero-variance -> smart impute -> wide fence on numeric -> features."""
    log = log if log is not None else P.StepLog()
    given = ROW_ID in df.columns
    df, order = in_order(df, order_by)
    df = nan_to_null(df)
    profiles = P.profile_columns(df, exact=False)
    types = {p.column: p.semantic_type for p in profiles}
    for t in sorted(set(types.values())):
        log.add("EXTRACT", f"type:{t}", ",".join(c for c, v in types.items() if v == t))
    dedup = materialize(C.drop_duplicates(df))   # read by every later pass of the chain
    log.add("TRANSFORM", "drop_duplicates", n=profiles[0].rows - dedup.count() if profiles else 0)
    # Dedup removes whole repeated rows, so each column keeps its set of distinct values.
    dedup, zero = C.drop_zero_variance(dedup, profiles)
    for c in zero:
        log.add("TRANSFORM", "drop_zero_variance", c)
    types = {c: t for c, t in types.items() if c in dedup.columns}
    imputed = C.smart_impute(dedup, types, order_by=order, log=log)
    nums = [c for c in imputed.columns if types.get(c) == "numeric"]
    fenced = C.wide_fence_filter(imputed, nums)
    log.add("TRANSFORM", "outlier_rows_removed", n=sum(fenced.removed.values()))
    engineered, added = FE.feature_engineer(fenced.frame, types)
    for a in added:
        log.add("TRANSFORM", "feature", a)
    return engineered if given else engineered.drop(ROW_ID), types


def etl(df: DataFrame, order_by=None, with_model: bool = True, boosted: bool = False, out_dir: str | None = None) -> dict:
    """The ETL flow: clean, re-type, statistics, histograms, value counts, correlations, auto-ML, and, with ``out_dir``, load."""
    log = P.StepLog()
    df, order = in_order(df, order_by)
    rows, cols = df.count(), len(data_columns(df))
    cleaned, _ = etl_clean(df, order_by, log)
    cleaned = materialize(cleaned)           # every statistic, chart and model reads it
    types = P.semantic_types(cleaned)
    nums = numeric_columns(cleaned)
    cats = [c for c in cleaned.columns if types.get(c) in ("categorical", "binary")]
    out = {
        "original_shape": (rows, cols), "cleaned": cleaned.drop(ROW_ID), "col_types": types,
        "stats": S.column_summary(cleaned, nums, digits=4), "distributions": S.histogram(cleaned, nums),
        "cat_counts": S.value_counts(cleaned, cats, 10), "corr": S.corr_matrix(cleaned, nums, digits=3),
        "preview": preview(nan_to_null(cleaned), order, 200).drop(ROW_ID), "logs": log,
    }
    target = ml.choose_target(cleaned)
    if with_model and target:
        log.add("ML", "target", target)
        model, failed = _guarded(lambda: ml.auto_ml(cleaned, target, types=types, boosted=boosted))
        out |= {"ml_error": failed} if failed else {"ml": model}
    if out_dir:
        out["paths"] = (load({"cleaned_csv": out["cleaned"]}, out_dir, log)
                        | load({"cleaned": out["cleaned"]}, out_dir, log, fmt="parquet"))
    return out


# ------------------------------------------------------------------ BI flavour

def bi_clean(df: DataFrame, log: P.StepLog | None = None) -> tuple[DataFrame, dict]:
    """C1 -> C4/C5 -> C8 on every numeric column."""
    dedup = materialize(C.drop_duplicates(nan_to_null(df)))   # read by the fills and every fence pass
    filled, fills = C.impute_basic(dedup)
    fenced = C.wide_fence_filter(filled)
    if log is not None:
        for c, v in fills.items():
            log.add("CLEAN", f"filled with {v}", c)
        for c, n in fenced.removed.items():
            log.add("CLEAN", "outlier_rows_removed", c, n)
    return fenced.frame, {"filled": fills, "outliers_removed": sum(fenced.removed.values())}


def bi_report(df: DataFrame, order_by=None, with_model: bool = True, out_dir: str | None = None) -> dict:
    """The BI flow and the report tables (A8): summary, cleaned data, statistics, category chart; with ``out_dir`` also
    as CSV folders."""
    log = P.StepLog()
    df, order = in_order(df, order_by)
    orig = (df.count(), len(data_columns(df)))
    log.add("EXTRACT", "rows", n=orig[0])
    cleaned, info = bi_clean(df, log)
    roles = detect_roles(cleaned, "bi")
    if roles.revenue and roles.cost:
        cleaned = FE.add_profit(cleaned, roles.revenue, roles.cost, "bi")
        log.add("FEATURE", f"profit:{roles.revenue}-{roles.cost}")
    cleaned = materialize(cleaned)           # the report tables and the model all read it
    out = {"original_shape": orig, "cleaned": cleaned.drop(ROW_ID), "roles": roles.as_dict(), "log": info, "steps": log}
    nums = numeric_columns(cleaned)
    out["summary"] = S.kpis(cleaned, roles.revenue, roles.cost)
    out["cleaned_data"] = nan_to_null(cleaned.drop(ROW_ID))
    out["statistics"] = S.column_summary(cleaned, nums, digits=2)
    out["stats"] = S.column_summary(cleaned, nums, digits=2, with_median=False).select(
        "column", "min", "max", "mean", "sum")
    if roles.category and roles.revenue:
        out["chart"] = S.group_top_k(cleaned, roles.category, roles.revenue, 10)
        out["cat_data"] = S.group_top_k(cleaned, roles.category, roles.revenue, 8, digits=None)
    if with_model and roles.revenue:
        model, failed = _guarded(ml.bi_forecast, cleaned, roles.revenue, order)
        out |= {"ml_error": failed} if failed else {"ml": model}
    out["preview"] = preview(nan_to_null(cleaned), order, 100).drop(ROW_ID)
    if out_dir:
        out["paths"] = load({k: out[k] for k in ("summary", "cleaned_data", "statistics", "chart") if k in out}, out_dir, log)
    return out


# ------------------------------------------------------------------ SQL flavour

def sql_prepare(df: DataFrame, log: P.StepLog | None = None) -> DataFrame:
    """S7 -> C1 -> C4/C5 -> Profit/margin (SQL roles)."""
    named = nan_to_null(clean_column_names(df))
    filled, fills = C.impute_basic(C.drop_duplicates(named))
    roles = detect_roles(filled, "sql", check_cardinality=False)
    if roles.revenue and roles.cost:
        filled = FE.add_profit(filled, roles.revenue, roles.cost, "sql")
    if log is not None:
        for before, after in zip(data_columns(df), data_columns(named)):
            if before != after:
                log.add("PREPARE", f"renamed from {before}", after)
        for c, v in fills.items():
            log.add("PREPARE", f"filled with {v}", c)
        if "Profit" in filled.columns and "Profit" not in named.columns:
            log.add("FEATURE", f"profit:{roles.revenue}-{roles.cost}")
    return filled


def sql_pack(df: DataFrame, table: str = "data", order_by=None, collect: bool = True, out_dir: str | None = None) -> dict:
    """The SQL flow: prepare, detect roles (category at most 50 distinct), run the pack, stats and charts; with
    ``out_dir`` also the prepared table and the pack's text."""
    log = P.StepLog()
    df, order = in_order(df, order_by)
    rows = materialize(sql_prepare(df, log)) # loaded once, queried by the whole pack
    prepared = rows.drop(ROW_ID)
    roles = detect_roles(prepared, "sql")
    prepared.createOrReplaceTempView(table)
    out = {"table": prepared, "roles": roles.as_dict(), "queries": run_pack(prepared, roles, table, collect=collect),
           "steps": log}
    for r in out["queries"].values():
        log.add("QUERY", r.key if not r.error else f"{r.key} failed: {r.error}", n=r.row_count if collect and not r.error else None)
    nums = numeric_columns(prepared)
    out["stats"] = S.column_summary(prepared, nums, digits=2, with_median=False).select(
        "column", "min", "max", "mean", "sum")
    if roles.category and roles.revenue:
        out["cat_revenue"] = S.group_top_k(prepared, roles.category, roles.revenue, 8)
    if roles.date and roles.revenue:
        out["trend"] = S.trend(prepared, roles.date, roles.revenue)
    out["preview"] = preview(nan_to_null(rows), order, 50).drop(ROW_ID)
    if out_dir:
        out["paths"] = load({table: prepared}, out_dir, log, fmt="parquet")
        out["paths"]["pack"] = export_pack_sql(prepared.sparkSession, out["queries"], f"{out_dir.rstrip('/')}/{table}_pack", table, table)
    return out

