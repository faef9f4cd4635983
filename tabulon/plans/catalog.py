"""Registry of runnable queries: name -> (Spark builder, DuckDB oracle SQL).

Every builder takes ``(spark, sf_dir)``, reads the driver tables (directly or
through the fixture views) and returns a lazy DataFrame over the whole
tables.  The oracle is the same computation in plain SQL, with the fixture
views inlined as CTEs; ``None`` marks a computation SQL cannot state
(model training), which gets a rows-only check.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from tabulon.functions.roles import Roles
from tabulon.plans import fixtures as fx
from tabulon.plans import querypack as qp


@dataclass
class Entry:
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Entry] = {}


def register(name: str, oracle: str | None):
    def deco(fn):
        REGISTRY[name] = Entry(fn, oracle.strip() if oracle else None)
        return fn
    return deco


def with_sales(sql: str) -> str:
    return f"WITH sales AS ({fx.SALES_SQL.strip()})\n{sql.strip()}"


def with_dirty(sql: str) -> str:
    return f"WITH dirty_events AS ({fx.DIRTY_EVENTS_SQL.strip()})\n{sql.strip()}"


# The sales view's roles by the SQL rule; fixed here so each registered query
# is one plan (``detect_roles`` finds the same, see tests).
SALES_ROLES = Roles(revenue="revenue", cost="cost", category="category", date="ship_date", qty="quantity")


def _sales(spark, sf_dir):
    return fx.sales(spark, sf_dir)


# ------------------------------------------------------------------ pack Q1-Q15

register("pack_overview", with_sales("SELECT COUNT(*) AS total_rows FROM sales"))(
    lambda s, d: qp.overview(_sales(s, d)))

register("pack_total_revenue", with_sales("""
SELECT ROUND(SUM(revenue), 2) AS total_revenue, ROUND(AVG(revenue), 2) AS avg_revenue,
       ROUND(MAX(revenue), 2) AS max_revenue, ROUND(MIN(revenue), 2) AS min_revenue FROM sales"""))(
    lambda s, d: qp.total_revenue(_sales(s, d), "revenue"))

register("pack_revenue_by_cat", with_sales("""
SELECT category, ROUND(SUM(revenue), 2) AS total_revenue, ROUND(AVG(revenue), 2) AS avg_revenue,
       COUNT(*) AS transactions FROM sales GROUP BY category"""))(
    lambda s, d: qp.revenue_by_cat(_sales(s, d), "category", "revenue"))

register("pack_top_performers", with_sales("""
SELECT category, ROUND(SUM(revenue), 2) AS total_revenue FROM sales GROUP BY category
ORDER BY total_revenue DESC, category LIMIT 5"""))(
    lambda s, d: qp.top_performers(_sales(s, d), "category", "revenue"))

register("pack_bottom_performers", with_sales("""
SELECT category, ROUND(SUM(revenue), 2) AS total_revenue FROM sales GROUP BY category
ORDER BY total_revenue ASC, category LIMIT 5"""))(
    lambda s, d: qp.bottom_performers(_sales(s, d), "category", "revenue"))

register("pack_having_filter", with_sales("""
SELECT category, ROUND(SUM(revenue), 2) AS total_revenue FROM sales GROUP BY category
HAVING ROUND(SUM(revenue), 2) > (SELECT AVG(t) FROM (SELECT SUM(revenue) AS t FROM sales GROUP BY category))"""))(
    lambda s, d: qp.having_filter(_sales(s, d), "category", "revenue"))

register("pack_cte_ranked", with_sales("""
, totals AS (SELECT category, SUM(revenue) AS part FROM sales GROUP BY category),
  grand AS (SELECT SUM(revenue) AS total FROM sales)
SELECT category, ROUND(part, 2) AS revenue, ROUND(part / total * 100, 2) AS revenue_share_pct
FROM totals, grand"""))(
    lambda s, d: qp.cte_ranked(_sales(s, d), "category", "revenue"))

register("pack_window_rank", with_sales("""
SELECT category, ROUND(SUM(revenue), 2) AS total_revenue,
       CAST(RANK() OVER (ORDER BY SUM(revenue) DESC) AS INTEGER) AS revenue_rank
FROM sales GROUP BY category"""))(
    lambda s, d: qp.window_rank(_sales(s, d), "category", "revenue"))

register("pack_window_running", with_sales("""
SELECT category, ROUND(SUM(revenue), 2) AS revenue,
       ROUND(SUM(SUM(revenue)) OVER (ORDER BY SUM(revenue) DESC), 2) AS running_total
FROM sales GROUP BY category"""))(
    lambda s, d: qp.window_running(_sales(s, d), "category", "revenue"))

# Q6-Q9 by a category without a bound on its values: one group for each order.
_BY_ORDER = "SELECT l_orderkey, SUM(l_quantity) AS part FROM lineitem GROUP BY l_orderkey"


def _lineitem(spark, sf_dir):
    return fx.table(spark, sf_dir, "lineitem")


register("pack_having_filter_wide", f"""
WITH g AS ({_BY_ORDER})
SELECT l_orderkey, ROUND(part, 2) AS total_revenue FROM g WHERE ROUND(part, 2) > (SELECT AVG(part) FROM g)""")(
    lambda s, d: qp.having_filter(_lineitem(s, d), "l_orderkey", "l_quantity", bounded=False))

register("pack_cte_ranked_wide", f"""
WITH g AS ({_BY_ORDER})
SELECT l_orderkey, ROUND(part, 2) AS revenue, ROUND(part / (SELECT SUM(part) FROM g) * 100, 2) AS revenue_share_pct FROM g""")(
    lambda s, d: qp.cte_ranked(_lineitem(s, d), "l_orderkey", "l_quantity", bounded=False))

register("pack_window_rank_wide", f"""
WITH g AS ({_BY_ORDER})
SELECT l_orderkey, ROUND(part, 2) AS total_revenue, RANK() OVER (ORDER BY part DESC) AS revenue_rank FROM g""")(
    lambda s, d: qp.window_rank(_lineitem(s, d), "l_orderkey", "l_quantity", bounded=False))

register("pack_window_running_wide", f"""
WITH g AS ({_BY_ORDER})
SELECT l_orderkey, ROUND(part, 2) AS revenue, ROUND(SUM(part) OVER (ORDER BY part DESC), 2) AS running_total FROM g""")(
    lambda s, d: qp.window_running(_lineitem(s, d), "l_orderkey", "l_quantity", bounded=False))

register("pack_profit_analysis", with_sales("""
SELECT category, ROUND(SUM(revenue), 2) AS revenue, ROUND(SUM(cost), 2) AS total_cost,
       ROUND(SUM(revenue) - SUM(cost), 2) AS net_profit FROM sales GROUP BY category"""))(
    lambda s, d: qp.profit_analysis(_sales(s, d), "revenue", "cost", "category"))

register("pack_profit_total", with_sales("""
SELECT 'All' AS group_label, ROUND(SUM(revenue), 2) AS revenue, ROUND(SUM(cost), 2) AS total_cost,
       ROUND(SUM(revenue) - SUM(cost), 2) AS net_profit FROM sales"""))(
    lambda s, d: qp.profit_analysis(_sales(s, d), "revenue", "cost", None))

register("pack_revenue_trend", with_sales("""
SELECT ship_date, ROUND(SUM(revenue), 2) AS total_revenue, COUNT(*) AS transactions
FROM sales GROUP BY ship_date"""))(
    lambda s, d: qp.revenue_trend(_sales(s, d), "ship_date", "revenue"))

register("pack_above_avg", with_sales("""
SELECT * FROM sales WHERE revenue > (SELECT AVG(revenue) FROM sales)
ORDER BY revenue DESC, order_id, line_no, ship_date, category, region, segment, quantity, cost LIMIT 20"""))(
    lambda s, d: qp.above_avg(_sales(s, d), "revenue"))

register("pack_null_check", with_sales("""
SELECT CAST(SUM(CASE WHEN order_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS order_id_nulls,
       CAST(SUM(CASE WHEN line_no IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS line_no_nulls,
       CAST(SUM(CASE WHEN ship_date IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS ship_date_nulls,
       CAST(SUM(CASE WHEN category IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS category_nulls,
       CAST(SUM(CASE WHEN region IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS region_nulls,
       CAST(SUM(CASE WHEN segment IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS segment_nulls,
       CAST(SUM(CASE WHEN quantity IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS quantity_nulls,
       CAST(SUM(CASE WHEN revenue IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS revenue_nulls,
       CAST(SUM(CASE WHEN cost IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS cost_nulls FROM sales"""))(
    lambda s, d: qp.null_check(_sales(s, d)))

register("pack_distinct_counts", with_sales("""
SELECT COUNT(DISTINCT order_id) AS order_id_unique, COUNT(DISTINCT line_no) AS line_no_unique,
       COUNT(DISTINCT ship_date) AS ship_date_unique, COUNT(DISTINCT category) AS category_unique,
       COUNT(DISTINCT region) AS region_unique, COUNT(DISTINCT segment) AS segment_unique,
       COUNT(DISTINCT quantity) AS quantity_unique, COUNT(DISTINCT revenue) AS revenue_unique,
       COUNT(DISTINCT cost) AS cost_unique FROM sales"""))(
    lambda s, d: qp.distinct_counts(_sales(s, d)))

register("pack_qty_revenue_corr", with_sales("""
SELECT ROUND(AVG(quantity), 2) AS avg_qty, ROUND(AVG(revenue), 2) AS avg_revenue,
       ROUND(SUM(revenue) / SUM(quantity), 2) AS overall_rev_per_unit FROM sales WHERE quantity > 0"""))(
    lambda s, d: qp.qty_revenue_corr(_sales(s, d), "quantity", "revenue"))

from tabulon.plans import catalog_clean  # noqa: E402,F401  (registers on import)
from tabulon.plans import catalog_stats  # noqa: E402,F401
from tabulon.plans import catalog_ml  # noqa: E402,F401
from tabulon.plans import catalog_io  # noqa: E402,F401
from tabulon.plans import catalog_flows  # noqa: E402,F401
