"""Registered profiling and cleaning queries over the ``dirty_events`` view (F-4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions.numeric import ROW_ID, q
from tabulon.operators import clean as C
from tabulon.operators import ordering as O
from tabulon.operators import profile as P
from tabulon.plans import fixtures as fx
from tabulon.plans.catalog import register, with_dirty
from tabulon.session import materialize, scratch_path
from tabulon.sources.csv import read_csv
from tabulon.sources.sinks import write_csv

DE_COLS = ["event_id", "event_date", "event_type", "amount", "sparse_id", "constant_col"]
DE_NUMERIC = ["event_id", "amount", "sparse_id", "constant_col"]


def _de(spark, d):
    return fx.dirty_events(spark, d)


# ------------------------------------------------------------------ SQL twins

def semantic_case_sql(col: str, kind: str, src: str) -> str:
    """The P1 rule in SQL for one column of physical ``kind`` (numeric/date/string)."""
    nd, n = f"COUNT(DISTINCT {col})", f"COUNT({col})"
    num_branch = f"CASE WHEN {nd} = 2 THEN 'binary' WHEN {nd} <= 15 THEN 'categorical_num' ELSE 'numeric' END"
    if kind == "date":
        body = "'datetime'"
    elif kind == "numeric":
        body = num_branch
    else:
        body = (f"CASE WHEN COUNT_IF({col} IS NOT NULL AND TRY_CAST({col} AS TIMESTAMP) IS NULL) = 0 THEN 'datetime' "
                f"WHEN COUNT_IF({col} IS NOT NULL AND TRY_CAST({col} AS DOUBLE) IS NULL) = 0 THEN {num_branch} "
                f"WHEN {nd} / {n} < 0.5 THEN 'categorical' ELSE 'text' END")
    return f"CASE WHEN {n} = 0 THEN 'empty' ELSE {body} END"


def fence_chain_sql(src: str, cols: list[str], lo_p: float, hi_p: float, k: float, only_if_outliers: bool,
                    prefix: str = "f") -> tuple[str, str]:
    """C7/C8 as a chain of CTEs, one filtering step per column; returns (ctes, last name)."""
    ctes, prev = [], src
    for i, c in enumerate(cols):
        b, s = f"{prefix}b{i}", f"{prefix}s{i}"
        ctes.append(f"{b} AS (SELECT q1 - {k} * (q3 - q1) AS lo, q3 + {k} * (q3 - q1) AS hi FROM "
                    f"(SELECT quantile_cont({c}, {lo_p}) AS q1, quantile_cont({c}, {hi_p}) AS q3 FROM {prev}))")
        inside = f"({c} >= lo AND {c} <= hi)"
        if only_if_outliers:
            cond = (f"lo IS NULL OR (SELECT COUNT(*) FROM {prev}, {b} WHERE {c} < lo OR {c} > hi) = 0 OR {inside}")
        else:
            cond = f"lo IS NULL OR {inside}"
        ctes.append(f"{s} AS (SELECT {prev}.* FROM {prev}, {b} WHERE {cond})")
        prev = s
    return ",\n".join(ctes), prev


# ------------------------------------------------------------------ profiling

_KINDS = {"event_id": "numeric", "event_date": "date", "event_type": "string", "amount": "numeric",
          "sparse_id": "numeric", "constant_col": "numeric"}
_PHYS = {"event_id": "bigint", "event_date": "date", "event_type": "string", "amount": "double",
         "sparse_id": "bigint", "constant_col": "int"}

register("profile_columns", with_dirty("\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", '{_PHYS[c]}' AS physical_type, {semantic_case_sql(c, _KINDS[c], 'dirty_events')} "
    f"AS semantic_type, COUNT({c}) AS n, COUNT(*) - COUNT({c}) AS n_missing, COUNT(DISTINCT {c}) AS n_distinct, "
    f"ROUND((COUNT(*) - COUNT({c})) / COUNT(*) * 100, 2) AS missing_pct FROM dirty_events" for c in DE_COLS)))(
    lambda s, d: P.column_profile(_de(s, d)))

register("profile_types_by_group", with_dirty(
    "SELECT semantic_type, string_agg(\"column\", ',' ORDER BY \"column\") AS columns FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {semantic_case_sql(c, _KINDS[c], 'dirty_events')} AS semantic_type "
                         f"FROM dirty_events" for c in DE_COLS) + ") GROUP BY semantic_type"))(
    lambda s, d: P.types_by_group(P.column_profile(_de(s, d)))
    .select("semantic_type", F.array_join("columns", ",").alias("columns")))

register("profile_missing", with_dirty("\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", COUNT(*) - COUNT({c}) AS n_missing, "
    f"ROUND((COUNT(*) - COUNT({c})) / COUNT(*) * 100, 2) AS missing_pct FROM dirty_events" for c in DE_COLS)))(
    lambda s, d: P.missing_report(_de(s, d)))

register("profile_duplicates", with_dirty("""
SELECT COUNT(*) AS n_rows, (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM dirty_events)) AS n_distinct_rows,
       COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM dirty_events)) AS n_duplicates FROM dirty_events"""))(
    lambda s, d: P.duplicate_count(_de(s, d)))


def _analyst_quality(spark, d):
    """P8 over the analyst cleaning chain: C1 -> C4/C5 -> C7 -> score."""
    de = _de(spark, d)
    rows_before = de.count()
    dedup = materialize(C.drop_duplicates(de))    # read by the fills, every fence pass and the score
    n_dedup = dedup.count()
    filled, _ = C.impute_basic(dedup)
    fenced = C.tukey_filter(filled).frame
    cols = fenced.columns
    stats = fenced.agg(F.count(F.lit(1)).alias("rows_after"),
                       sum((F.count_if(q(c).isNull()) for c in cols), F.lit(0)).alias("missing_cells")).first()
    score = P.quality_score(rows_before, rows_before - n_dedup, stats["missing_cells"], stats["rows_after"], len(cols))
    return spark.createDataFrame(
        [(rows_before, rows_before - n_dedup, stats["rows_after"], int(stats["missing_cells"]), score)],
        "rows_before bigint, duplicates_removed bigint, rows_after bigint, missing_cells bigint, quality_score int")


_imp_cols = []
for _c in DE_COLS:
    if _c in ("amount", "sparse_id"):
        _imp_cols.append(f"COALESCE(CAST({_c} AS DOUBLE), (SELECT median({_c}) FROM u)) AS {_c}")
    elif _c in ("event_date", "event_type"):
        _imp_cols.append(f"COALESCE({_c}, (SELECT {_c} FROM u WHERE {_c} IS NOT NULL GROUP BY {_c} "
                         f"ORDER BY COUNT(*) DESC, {_c} LIMIT 1)) AS {_c}")
    else:
        _imp_cols.append(_c)
_IMPUTED = f"u AS (SELECT DISTINCT * FROM dirty_events),\nimp AS (SELECT {', '.join(_imp_cols)} FROM u)"
_chain, _last = fence_chain_sql("imp", DE_NUMERIC, 0.25, 0.75, 1.5, True, "t")
_missing_after = "CAST(" + " + ".join(f"COUNT_IF({c} IS NULL)" for c in DE_COLS) + " AS BIGINT)"
register("quality_score", with_dirty(f"""
, {_IMPUTED},
{_chain},
m AS (SELECT COUNT(*) AS rows_after, {_missing_after} AS missing_cells FROM {_last}),
b AS (SELECT (SELECT COUNT(*) FROM dirty_events) AS rows_before, (SELECT COUNT(*) FROM u) AS n_dedup)
SELECT rows_before, rows_before - n_dedup AS duplicates_removed, rows_after, missing_cells,
       CAST(GREATEST(0, FLOOR(100
            - CASE WHEN missing_cells > 0 THEN LEAST(30, missing_cells / (rows_after * {len(DE_COLS)}) * 100) ELSE 0 END
            - CASE WHEN rows_before > n_dedup THEN LEAST(10, (rows_before - n_dedup) / rows_before * 50) ELSE 0 END))
            AS INTEGER) AS quality_score
FROM m, b"""))(_analyst_quality)

# ------------------------------------------------------------------ cleaning

register("clean_dedup", with_dirty("SELECT DISTINCT * FROM dirty_events"))(
    lambda s, d: C.drop_duplicates(_de(s, d)))

register("clean_drop_sparse", with_dirty(
    "SELECT event_id, event_date, event_type, amount, constant_col FROM dirty_events"))(
    lambda s, d: C.drop_sparse(_de(s, d))[0])

register("clean_drop_constant", with_dirty(
    "SELECT event_id, event_date, event_type, amount, sparse_id FROM dirty_events"))(
    lambda s, d: C.drop_zero_variance(_de(s, d))[0])

register("clean_fill_median", with_dirty("""
SELECT event_id, event_date, event_type,
       COALESCE(amount, (SELECT median(amount) FROM dirty_events)) AS amount,
       COALESCE(CAST(sparse_id AS DOUBLE), (SELECT median(sparse_id) FROM dirty_events)) AS sparse_id,
       constant_col FROM dirty_events"""))(
    lambda s, d: C.fill_median(_de(s, d))[0])

register("clean_fill_mean", with_dirty("""
SELECT event_id, event_date, event_type,
       COALESCE(amount, (SELECT avg(amount) FROM dirty_events)) AS amount,
       COALESCE(CAST(sparse_id AS DOUBLE), (SELECT avg(sparse_id) FROM dirty_events)) AS sparse_id,
       constant_col FROM dirty_events"""))(
    lambda s, d: C.fill_mean(_de(s, d))[0])

register("clean_fill_zero", with_dirty("""
SELECT COALESCE(event_id, 0) AS event_id, event_date, event_type, COALESCE(amount, 0) AS amount,
       COALESCE(sparse_id, 0) AS sparse_id, COALESCE(constant_col, 0) AS constant_col FROM dirty_events"""))(
    lambda s, d: C.fill_constant(_de(s, d), 0))

register("clean_fill_mode", with_dirty("""
SELECT event_id,
       COALESCE(event_date, (SELECT event_date FROM dirty_events WHERE event_date IS NOT NULL
                             GROUP BY event_date ORDER BY COUNT(*) DESC, event_date LIMIT 1)) AS event_date,
       COALESCE(event_type, (SELECT event_type FROM dirty_events WHERE event_type IS NOT NULL
                             GROUP BY event_type ORDER BY COUNT(*) DESC, event_type LIMIT 1)) AS event_type,
       amount, sparse_id, constant_col FROM dirty_events"""))(
    lambda s, d: C.fill_mode(_de(s, d))[0])

register("clean_impute_basic", with_dirty(f", {_IMPUTED}\nSELECT * FROM imp"))(
    lambda s, d: C.impute_basic(C.drop_duplicates(_de(s, d)))[0])

register("clean_forward_fill", with_dirty("""
SELECT event_id,
       last_value(event_date IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
         AS event_date,
       event_type, amount, sparse_id, constant_col FROM dirty_events"""))(
    lambda s, d: O.forward_fill(_de(s, d), ["event_date"], "event_id"))

_c7, _c7_last = fence_chain_sql("dirty_events", DE_NUMERIC, 0.25, 0.75, 1.5, True, "c")
register("clean_tukey_filter", with_dirty(f", {_c7}\nSELECT * FROM {_c7_last}"))(
    lambda s, d: C.tukey_filter(_de(s, d)).frame)

_c8, _c8_last = fence_chain_sql("dirty_events", DE_NUMERIC, 0.01, 0.99, 3.0, False, "w")
register("clean_wide_fence", with_dirty(f", {_c8}\nSELECT * FROM {_c8_last}"))(
    lambda s, d: C.wide_fence_filter(_de(s, d)).frame)

register("clean_drop_incomplete", with_dirty("""
SELECT * FROM dirty_events WHERE event_id IS NOT NULL AND event_date IS NOT NULL AND event_type IS NOT NULL
  AND amount IS NOT NULL AND sparse_id IS NOT NULL AND constant_col IS NOT NULL"""))(
    lambda s, d: C.drop_incomplete(_de(s, d)))


def _coerce_src(spark, d):
    ev = fx.table(spark, d, "events")
    return ev.select("event_id", F.when(F.col("event_id") % 9 == 0, F.lit("n/a"))
                     .otherwise(F.col("value").cast("string")).alias("value_text"))


register("clean_coerce_numeric", """
SELECT event_id, TRY_CAST(CASE WHEN event_id % 9 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE)
       AS value_text FROM events""")(
    lambda s, d: C.coerce_numeric(_coerce_src(s, d), ["value_text"]))

# ------------------------------------------------------------------ ordering

register("row_index", """
SELECT event_id, user_id, CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS row_index FROM events""")(
    lambda s, d: O.row_index(fx.table(s, d, "events").select("event_id", "user_id"), "event_id"))

register("preview_first_rows", """
SELECT event_id, ts, user_id, event_type, value FROM events ORDER BY event_id LIMIT 100""")(
    lambda s, d: O.preview(fx.table(s, d, "events").select("event_id", "ts", "user_id", "event_type", "value"),
                           "event_id", 100))

register("page_rows", """
SELECT event_id, ts, user_id, event_type, value FROM events ORDER BY event_id LIMIT 12 OFFSET 36""")(
    lambda s, d: O.page(fx.table(s, d, "events").select("event_id", "ts", "user_id", "event_type", "value"),
                        "event_id", 3))

# ------------------------------------------------------------------ the ETL cleaning flow end to end


def _etl_clean(spark, d):
    from tabulon.plans.workflows import etl_clean
    return etl_clean(_de(spark, d), order_by=["event_id"])[0]


_etl_fence, _etl_last = fence_chain_sql("imp", ["event_id", "amount"], 0.01, 0.99, 3.0, False, "e")
_ETL_SQL = with_dirty(f"""
, u AS (SELECT DISTINCT * FROM dirty_events),
imp AS (SELECT event_id,
               last_value(event_date IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING
                                                         AND CURRENT ROW) AS event_date,
               COALESCE(event_type, (SELECT event_type FROM u WHERE event_type IS NOT NULL GROUP BY event_type
                                     ORDER BY COUNT(*) DESC, event_type LIMIT 1)) AS event_type,
               COALESCE(amount, (SELECT median(amount) FROM u)) AS amount
        FROM u),
{_etl_fence}
SELECT *, CAST(year(event_date) AS INTEGER) AS event_date_year, CAST(month(event_date) AS INTEGER) AS event_date_month,
       CAST(day(event_date) AS INTEGER) AS event_date_day, CAST(isodow(event_date) - 1 AS INTEGER) AS event_date_dow
FROM {_etl_last}""")
register("etl_clean", _ETL_SQL)(_etl_clean)


def _etl_clean_scan_order(spark, d):
    """The same from CSV files and without ``order_by``: dates are filled in the order of the files."""
    from tabulon.plans.workflows import etl_clean
    path = scratch_path(spark, "dirty-events-csv")
    write_csv(_de(spark, d).orderBy("event_id"), path)
    return etl_clean(read_csv(spark, path, row_ids=True))[0].drop(ROW_ID)


register("etl_clean_scan_order", _ETL_SQL)(_etl_clean_scan_order)
