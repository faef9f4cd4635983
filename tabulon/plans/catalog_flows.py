"""Registered queries for roles, targets, logs, the LOAD step and scans of untidy headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions.numeric import nan_to_null
from tabulon.functions.roles import detect_roles
from tabulon.operators import ml
from tabulon.operators import profile as P
from tabulon.plans import adhoc
from tabulon.plans import fixtures as fx
from tabulon.plans import workflows as W
from tabulon.plans.catalog import register, with_dirty, with_sales
from tabulon.plans.catalog_clean import _ETL_SQL, _etl_last
from tabulon.session import scratch_path
from tabulon.sources.csv import limit_rows, read_csv
from tabulon.sources.sinks import write_csv

# ------------------------------------------------------------------ scans


def _first_rows(spark, d):
    path = scratch_path(spark, "events-csv")
    write_csv(fx.table(spark, d, "events").select("event_id", "user_id", "event_type").orderBy("event_id"), path)
    return limit_rows(read_csv(spark, path), 500)


register("csv_first_rows", "SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 500")(_first_rows)


def _tokens(spark, d):
    """Missing-value tokens and header names that need cleaning, two of which clash afterwards."""
    ev = fx.table(spark, d, "events")
    marks = F.element_at(F.array(*[F.lit(t) for t in ("NA", "n/a", "", "NULL", "-nan", "None")]), (F.col("event_id") % 6 + 1).cast("int"))
    path = scratch_path(spark, "events-tokens")
    write_csv(ev.select(F.col("event_id").alias(" event id "), F.when(F.col("event_id") % 3 == 0, marks).otherwise(F.col("event_type")).alias("type?"),
                        F.when(F.col("event_id") % 4 == 0, marks).otherwise(F.col("user_id").cast("string")).alias("type!")), path, sep="|")
    return read_csv(spark, path, clean_names=True)


register("csv_tokens_and_names", """
SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_type END AS type_, CASE WHEN event_id % 4 <> 0 THEN user_id END AS type__2
FROM events""")(_tokens)

register("clean_nan_to_null", """
SELECT event_id, CASE WHEN event_id % 5 > 1 THEN value END AS value FROM events""")(
    lambda s, d: nan_to_null(fx.table(s, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, float("nan"))
                             .when(F.col("event_id") % 5 == 1, float("-inf")).otherwise(F.col("value")).alias("value"))))

# ------------------------------------------------------------------ roles, targets

_FLAVOURS = ["etl", "bi", "sql"]


def _roles(spark, d):
    sales = fx.sales(spark, d)
    rows = [(f, role, column) for f in _FLAVOURS for role, column in detect_roles(sales, f).as_dict().items() if column]
    return spark.createDataFrame(rows, "flavour string, role string, `column` string")


register("detect_roles", with_sales("""
, few AS (SELECT count(DISTINCT category) <= 50 AS ok FROM sales),
r(flavour, role, "column") AS (VALUES ('etl', 'revenue', 'revenue'), ('etl', 'cost', 'cost'), ('etl', 'qty', 'quantity'),
  ('bi', 'revenue', 'revenue'), ('bi', 'cost', 'cost'), ('bi', 'category', 'category'), ('bi', 'date', 'ship_date'), ('bi', 'qty', 'quantity'),
  ('sql', 'revenue', 'revenue'), ('sql', 'cost', 'cost'), ('sql', 'category', 'category'), ('sql', 'date', 'ship_date'), ('sql', 'qty', 'quantity'))
SELECT r.* FROM r, few WHERE ok OR role <> 'category' OR flavour <> 'sql'"""))(_roles)


def _targets(spark, d):
    rows = []
    for name, df in (("sales", fx.sales(spark, d)), ("labels", fx.table(spark, d, "labels")), ("events", fx.table(spark, d, "events"))):
        target = ml.choose_target(df)
        rows.append((name, target, ml.detect_problem_type(df, target, P.semantic_types(df))))
    return spark.createDataFrame(rows, "name string, target string, problem string")


register("ml_targets", with_sales("""
SELECT 'sales' AS name, 'revenue' AS target, CASE WHEN count(DISTINCT revenue) <= 10 THEN 'classification' ELSE 'regression' END AS problem FROM sales
UNION ALL SELECT 'labels', 'toxic', CASE WHEN count(DISTINCT toxic) <= 10 THEN 'classification' ELSE 'regression' END FROM labels
UNION ALL SELECT 'events', 'value', CASE WHEN count(DISTINCT value) <= 10 THEN 'classification' ELSE 'regression' END FROM events"""))(_targets)

# ------------------------------------------------------------------ heatmap (V4), ad-hoc result

_HEAT = ["order_id", "line_no", "quantity", "revenue", "cost"]
register("chart_heatmap", with_sales("\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) + 0.0 AS corr FROM sales" for a in _HEAT for b in _HEAT)))(
    lambda s, d: W.chart(fx.sales(s, d), "heatmap").select("col_a", "col_b", (F.round("corr", 6) + F.lit(0.0)).alias("corr")))


def _adhoc_result(spark, d):
    r = adhoc.run_custom_query(spark, "SELECT event_id, event_type, value FROM ev WHERE value > 50 ORDER BY event_id", {"ev": fx.table(spark, d, "events")})
    shown = spark.createDataFrame([(x["event_id"], x["event_type"], x["value"]) for x in r.rows], "event_id long, event_type string, value double")
    return shown.withColumn("row_count", F.lit(r.row_count).cast("long")).withColumn("error", F.lit(r.error).cast("string"))


register("adhoc_result", """
SELECT event_id, event_type, value, (SELECT count(*) FROM events WHERE value > 50) AS row_count, CAST(NULL AS VARCHAR) AS error
FROM events WHERE value > 50 ORDER BY event_id LIMIT 200""")(_adhoc_result)

# ------------------------------------------------------------------ change log and LOAD


def _etl_log(spark, d):
    log = P.StepLog()
    W.etl_clean(fx.dirty_events(spark, d), order_by=["event_id"], log=log)
    return log.frame(spark).where("phase = 'TRANSFORM'").select("column", "action", "n")


register("etl_change_log", _ETL_SQL.split("SELECT *, CAST(year(event_date)")[0] + """
SELECT CAST(NULL AS VARCHAR) AS "column", 'drop_duplicates' AS action, (SELECT count(*) FROM dirty_events) - (SELECT count(*) FROM u) AS n
UNION ALL SELECT 'constant_col', 'drop_zero_variance', NULL UNION ALL SELECT 'sparse_id', 'drop_sparse_column', NULL
UNION ALL SELECT 'amount', 'fill_median', (SELECT count(*) FROM u WHERE amount IS NULL)
UNION ALL SELECT 'event_date', 'forward_fill', (SELECT count(*) FROM u WHERE event_date IS NULL)
UNION ALL SELECT 'event_type', 'fill_mode', (SELECT count(*) FROM u WHERE event_type IS NULL)
UNION ALL SELECT NULL, 'outlier_rows_removed', (SELECT count(*) FROM imp) - (SELECT count(*) FROM """ + _etl_last + """)
UNION ALL SELECT NULL, 'date_parts:event_date' AS action, NULL""")(
    lambda s, d: _etl_log(s, d).withColumn("action", F.when(F.col("action") == "feature", F.col("column")).otherwise(F.col("action")))
    .withColumn("column", F.when(F.col("action").startswith("date_parts"), F.lit(None)).otherwise(F.col("column"))))


def _loaded(fmt):
    def run(spark, d):
        log = P.StepLog()
        cleaned = W.etl_clean(fx.dirty_events(spark, d), order_by=["event_id"], log=log)[0]
        path = W.load({"cleaned": cleaned}, scratch_path(spark, "etl-out"), log, fmt=fmt)["cleaned"]
        back = read_csv(spark, path) if fmt == "csv" else spark.read.parquet(path)
        return back.select(*[F.col(f.name).cast(f.dataType) for f in cleaned.schema.fields])
    return run


register("etl_loaded_csv", _ETL_SQL)(_loaded("csv"))
register("etl_loaded_table", _ETL_SQL)(_loaded("parquet"))
