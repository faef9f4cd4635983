"""Registered statistics, chart-data, feature and ad-hoc queries over the ``sales`` view (F-3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions.numeric import DATE_TYPES
from tabulon.operators import features as FE
from tabulon.operators import profile as P
from tabulon.operators import stats as S
from tabulon.plans import adhoc as AD
from tabulon.plans import fixtures as fx
from tabulon.plans.catalog import register, with_sales

SALES_NUMERIC = ["order_id", "line_no", "quantity", "revenue", "cost"]


def _sales(spark, d):
    return fx.sales(spark, d)


# ------------------------------------------------------------------ A1-A7

register("stats_column_summary", with_sales("\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", round_even(MIN(CAST({c} AS DOUBLE)), 4) AS min, round_even(MAX(CAST({c} AS DOUBLE)), 4) AS max, "
    f"round_even(AVG(CAST({c} AS DOUBLE)), 4) AS mean, round_even(median(CAST({c} AS DOUBLE)), 4) AS median, "
    f"round_even(stddev_samp(CAST({c} AS DOUBLE)), 4) AS std, "
    f"CAST(round_even(SUM(CAST(CAST({c} AS DOUBLE) AS DECIMAL(38, 10))), 4) AS DOUBLE) AS sum, COUNT({c}) AS count, "
    f"round_even((COUNT(*) - COUNT({c})) / COUNT(*) * 100, 2) AS missing_pct FROM sales" for c in SALES_NUMERIC)))(
    lambda s, d: S.column_summary(_sales(s, d)))


def _half_even(value: str) -> str:
    """Two digits, half even, on the decimal that a double prints as (scaling the double itself would lose the tie)."""
    y = f"CAST(CAST({value} AS VARCHAR) AS DECIMAL(36, 14)) * 100"
    tie = f"(({y}) - floor({y}) = 0.5 AND abs(floor({y})) % 2 = 1)"
    return f"CAST((floor({y}) + CASE WHEN ({y}) - floor({y}) > 0.5 OR {tie} THEN 1 ELSE 0 END) AS DOUBLE) / 100"


def _hist_sql(cols, bins=20):
    ctes, parts = [], []
    for i, c in enumerate(cols):
        ctes.append(f"r{i} AS (SELECT CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, "
                    f"CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM "
                    f"(SELECT MIN(CAST({c} AS DOUBLE)) AS lo, MAX(CAST({c} AS DOUBLE)) AS hi FROM sales))")
        ctes.append(f"b{i} AS (SELECT LEAST(CAST(FLOOR((CAST({c} AS DOUBLE) - lo) * ({float(bins)} / (hi - lo))) AS INTEGER), "
                    f"{bins - 1}) AS bin FROM sales, r{i} WHERE {c} IS NOT NULL)")
        parts.append(f"SELECT '{c}' AS \"column\", CAST(g.bin AS INTEGER) AS bin, "
                     f"{_half_even(f'lo + g.bin * ((hi - lo) / {bins})')} AS left_edge, COUNT(b.bin) AS count "
                     f"FROM (SELECT range AS bin FROM range({bins})) g CROSS JOIN r{i} LEFT JOIN b{i} b ON b.bin = g.bin "
                     f"GROUP BY g.bin, lo, hi")
    return with_sales(", " + ",\n".join(ctes) + "\n" + "\nUNION ALL\n".join(parts))


register("stats_histogram", _hist_sql(SALES_NUMERIC))(
    lambda s, d: S.histogram(_sales(s, d)))


def _value_counts(spark, d):
    df = _sales(spark, d)
    types = P.semantic_types(df)
    cats = [c for c in df.columns if types.get(c) in ("categorical", "binary")]
    return S.value_counts(df, cats, 10)


register("stats_value_counts", with_sales("""
, u AS (SELECT 'category' AS "column", category AS value FROM sales UNION ALL
        SELECT 'region', region FROM sales UNION ALL SELECT 'segment', segment FROM sales),
c AS (SELECT "column", value, COUNT(*) AS count FROM u WHERE value IS NOT NULL GROUP BY "column", value),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS INTEGER) AS rank FROM c)
SELECT * FROM r WHERE rank <= 10"""))(_value_counts)


def _corr_sql(cols):
    parts = []
    for a in cols:
        for b in cols:
            pa, pb = f"CASE WHEN {b} IS NOT NULL THEN CAST({a} AS DOUBLE) END", f"CASE WHEN {a} IS NOT NULL THEN CAST({b} AS DOUBLE) END"
            den = f"(stddev_pop({pa}) * stddev_pop({pb}))"
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round_even(CASE WHEN {den} = 0 THEN NULL ELSE "
                         f"covar_pop({pa}, {pb}) / {den} END, 3) + 0.0 AS corr FROM sales")
    return with_sales("\nUNION ALL\n".join(parts))


register("stats_corr_matrix", _corr_sql(SALES_NUMERIC))(
    lambda s, d: S.corr_matrix(_sales(s, d)))

register("stats_group_top_k", with_sales("""
SELECT category, round_even(SUM(revenue), 2) AS total FROM sales WHERE category IS NOT NULL GROUP BY category
ORDER BY total DESC, category LIMIT 8"""))(
    lambda s, d: S.group_top_k(_sales(s, d), "category", "revenue", 8))

register("stats_trend", with_sales("""
SELECT ship_date, round_even(SUM(revenue), 2) AS total FROM sales WHERE ship_date IS NOT NULL GROUP BY ship_date"""))(
    lambda s, d: S.trend(_sales(s, d), "ship_date", "revenue"))

register("stats_kpis", with_sales("""
SELECT 'Total Records' AS kpi, CAST(COUNT(*) AS DOUBLE) AS value FROM sales
UNION ALL SELECT 'Columns', 9.0
UNION ALL SELECT 'Total Revenue', round_even(SUM(COALESCE(revenue, 0)), 2) FROM sales
UNION ALL SELECT 'Net Profit', round_even(SUM(COALESCE(revenue, 0)) - SUM(COALESCE(cost, 0)), 2) FROM sales"""))(
    lambda s, d: S.kpis(_sales(s, d), "revenue", "cost", digits=2))

# ------------------------------------------------------------------ V1-V6

register("chart_bar", with_sales(
    "SELECT category, CAST(SUM(order_id) AS DOUBLE) AS value FROM sales GROUP BY category"))(
    lambda s, d: S.bar_data(_sales(s, d)).select("category", F.col("value").cast("double").alias("value")))

register("chart_pie", with_sales("SELECT category, COUNT(*) AS count FROM sales GROUP BY category"))(
    lambda s, d: S.pie_data(_sales(s, d)))

register("chart_line", with_sales("SELECT order_id AS x, line_no AS y FROM sales"))(
    lambda s, d: S.xy_data(_sales(s, d), ["order_id", "line_no"]))

register("chart_scatter", with_sales("SELECT order_id AS x, line_no AS y FROM sales"))(
    lambda s, d: S.xy_data(_sales(s, d)))

register("chart_box", with_sales("""
, b AS (SELECT MIN(CAST(order_id AS DOUBLE)) AS min, quantile_cont(order_id, 0.25) AS q1,
               quantile_cont(order_id, 0.5) AS median, quantile_cont(order_id, 0.75) AS q3,
               MAX(CAST(order_id AS DOUBLE)) AS max FROM sales)
SELECT 'order_id' AS "column", min, q1, median, q3, max, q1 - 1.5 * (q3 - q1) AS lower_fence,
       q3 + 1.5 * (q3 - q1) AS upper_fence,
       (SELECT COUNT(*) FROM sales WHERE order_id < q1 - 1.5 * (q3 - q1) OR order_id > q3 + 1.5 * (q3 - q1))
         AS n_outliers FROM b"""))(
    lambda s, d: S.box_data(_sales(s, d)))

# ------------------------------------------------------------------ F1-F4

register("features_profit", with_sales("""
SELECT *, revenue - cost AS Profit, round_even((revenue - cost) / NULLIF(revenue, 0) * 100, 2) AS Profit_Margin_Pct
FROM sales"""))(
    lambda s, d: FE.add_profit(_sales(s, d), "revenue", "cost", "sql"))

register("features_profit_bi", with_sales("""
SELECT order_id, line_no, ship_date, category, region, segment, quantity,
       COALESCE(revenue, 0) AS revenue, COALESCE(cost, 0) AS cost,
       COALESCE(revenue, 0) - COALESCE(cost, 0) AS Profit,
       COALESCE(round_even((COALESCE(revenue, 0) - COALESCE(cost, 0)) / NULLIF(COALESCE(revenue, 0), 0) * 100, 2), 0)
         AS "Profit_Margin_%" FROM sales"""))(
    lambda s, d: FE.add_profit(_sales(s, d), "revenue", "cost", "bi"))

register("features_date_parts", with_sales("""
SELECT *, CAST(year(ship_date) AS INTEGER) AS ship_date_year, CAST(month(ship_date) AS INTEGER) AS ship_date_month,
       CAST(day(ship_date) AS INTEGER) AS ship_date_day, CAST(isodow(ship_date) - 1 AS INTEGER) AS ship_date_dow
FROM sales"""))(
    lambda s, d: FE.date_parts(_sales(s, d), ["ship_date"]))


def _etl_features(spark, d):
    li = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                                               "l_shipdate")
    types = {f.name: "datetime" for f in li.schema.fields if isinstance(f.dataType, DATE_TYPES)}
    return FE.feature_engineer(li, types)[0]


register("features_engineer_lineitem", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate,
       CAST(year(l_shipdate) AS INTEGER) AS l_shipdate_year, CAST(month(l_shipdate) AS INTEGER) AS l_shipdate_month,
       CAST(day(l_shipdate) AS INTEGER) AS l_shipdate_day, CAST(isodow(l_shipdate) - 1 AS INTEGER) AS l_shipdate_dow,
       l_quantity * l_extendedprice AS Total_Value
FROM lineitem""")(_etl_features)

# ------------------------------------------------------------------ G1-G3 (same text in both engines)

ADHOC = {
    "adhoc_aggregate_join": """
SELECT s.category, COUNT(*) AS n_above FROM sales s
JOIN (SELECT category, AVG(revenue) AS avg_rev FROM sales GROUP BY category) a ON s.category = a.category
WHERE s.revenue > a.avg_rev GROUP BY s.category""",
    "adhoc_semi_join": """
SELECT segment, COUNT(*) AS n FROM sales
WHERE order_id IN (SELECT order_id FROM sales WHERE quantity >= 49) GROUP BY segment""",
    "adhoc_anti_join": """
SELECT region, COUNT(*) AS n FROM sales s
WHERE NOT EXISTS (SELECT 1 FROM sales t WHERE t.order_id = s.order_id AND t.quantity >= 45) GROUP BY region""",
    "adhoc_set_ops": """
SELECT region AS name FROM sales WHERE segment = 'BUILDING'
INTERSECT SELECT region FROM sales WHERE category = 'PROMO'
UNION SELECT category FROM sales WHERE quantity > 49
EXCEPT SELECT category FROM sales WHERE category = 'SMALL'""",
    "adhoc_window": """
SELECT category, ship_date, revenue_day,
       ROUND(SUM(revenue_day) OVER (PARTITION BY category ORDER BY ship_date ROWS UNBOUNDED PRECEDING), 2) AS running,
       CAST(DENSE_RANK() OVER (PARTITION BY category ORDER BY revenue_day DESC) AS INTEGER) AS day_rank
FROM (SELECT category, ship_date, ROUND(SUM(revenue), 2) AS revenue_day FROM sales GROUP BY category, ship_date) t""",
    "adhoc_distinct_order_limit": """
SELECT DISTINCT region, segment FROM sales ORDER BY region, segment LIMIT 10 OFFSET 5""",
    "adhoc_scalar_functions": """
SELECT upper(substr(category, 1, 3)) AS cat3, CAST(year(ship_date) AS INTEGER) AS yr,
       COUNT(*) AS n, ROUND(AVG(ln(revenue)), 4) AS avg_log_revenue,
       CAST(SUM(CASE WHEN lower(region) LIKE '%ia' THEN 1 ELSE 0 END) AS BIGINT) AS n_ia
FROM sales GROUP BY upper(substr(category, 1, 3)), CAST(year(ship_date) AS INTEGER)""",
}


ADHOC.update({
    "adhoc_left_join": """
SELECT c.category, c.n, r.region, r.n_region FROM
  (SELECT category, COUNT(*) AS n FROM sales GROUP BY category) c
LEFT JOIN (SELECT category, region, COUNT(*) AS n_region FROM sales WHERE quantity > 48 GROUP BY category, region) r
  ON c.category = r.category AND r.region = 'ASIA'""",
    "adhoc_theta_join": """
SELECT b.band, COUNT(*) AS n, ROUND(SUM(s.revenue), 2) AS revenue FROM sales s
JOIN (VALUES (0.0, 20000.0, 'low'), (20000.0, 60000.0, 'mid'), (60000.0, 1.0e12, 'high')) AS b(lo, hi, band)
  ON s.revenue >= b.lo AND s.revenue < b.hi
GROUP BY b.band""",
})


def _adhoc(sql):
    return lambda s, d: AD.query(s, sql, {"sales": _sales(s, d)})


for _name, _sql in ADHOC.items():
    register(_name, with_sales(_sql))(_adhoc(_sql))


def _search(spark, d):
    from tabulon.operators.ordering import search
    return search(fx.table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand"), "Ring ")


register("adhoc_json_functions", """
SELECT event_type, CAST(SUM(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, COUNT(*) AS n
FROM events GROUP BY event_type""")(
    lambda s, d: AD.query(s, """
SELECT event_type, SUM(CAST(get_json_object(props, '$.k') AS BIGINT)) AS k_sum, COUNT(*) AS n
FROM events GROUP BY event_type""", {"events": fx.table(s, d, "events")}))


register("search_rows", """
SELECT p_partkey, p_name, p_type, p_brand FROM part
WHERE contains(lower(concat_ws('', CAST(p_partkey AS VARCHAR), p_name, p_type, p_brand)), 'ring')""")(_search)
