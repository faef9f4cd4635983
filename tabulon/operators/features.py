"""Feature engineering as projections (F1-F4; F6 lives in ``ordering``).

Every derived column is a built-in expression appended with one ``select``,
so it stays inside whole-stage codegen next to the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.numeric import DATE_TYPES, q, to_number
from tabulon.functions.roles import ETL_KEYWORDS, first_match

MARGIN_NAME = {"etl": "Profit_Margin_%", "bi": "Profit_Margin_%", "sql": "Profit_Margin_Pct"}


def set_columns(df: DataFrame, new: dict) -> DataFrame:
    """Assign columns like ``frame[name] = expr``: an existing column is replaced
    in place, a new one is appended; one projection for all of them."""
    exprs = [(new[c].alias(c) if c in new else q(c)) for c in df.columns]
    exprs += [e.alias(c) for c, e in new.items() if c not in df.columns]
    return df.select(*exprs)


def add_profit(df: DataFrame, rev: str, cost: str, flavour: str = "sql") -> DataFrame:
    """``Profit = revenue - cost`` and margin % (2 dp, half even like pandas).

    ``etl``/``sql``: zero revenue gives a null margin (pandas inf/NaN, nulled
    in output).  ``bi``: revenue and cost are coerced and null-filled with 0
    first (replacing the columns), and a zero-revenue margin is 0.
    """
    number = lambda name: to_number(name, df.schema[name].dataType)
    if flavour == "bi":
        r = F.coalesce(number(rev), F.lit(0.0))
        c = F.coalesce(number(cost), F.lit(0.0))
        base = set_columns(df, {rev: r, cost: c})
        profit = q(rev) - q(cost)
        margin = F.coalesce(F.bround(F.try_divide(profit, F.when(q(rev) != 0, q(rev))) * 100, 2), F.lit(0.0))
        return set_columns(base, {"Profit": profit, MARGIN_NAME["bi"]: margin})
    profit = number(rev) - number(cost)
    margin = F.bround(F.try_divide(profit, number(rev)) * 100, 2)
    return set_columns(df, {"Profit": profit, MARGIN_NAME[flavour]: margin})


def _as_timestamp(df: DataFrame, c: str):
    if isinstance(df.schema[c].dataType, DATE_TYPES):
        return q(c)
    return F.try_to_timestamp(q(c).cast("string"))


def date_parts(df: DataFrame, cols: list[str]) -> DataFrame:
    """``<c>_year, _month, _day, _dow`` (Monday = 0); unparsable values give nulls."""
    new = {}
    for c in cols:
        t = _as_timestamp(df, c)
        new.update({f"{c}_year": F.year(t), f"{c}_month": F.month(t), f"{c}_day": F.dayofmonth(t),
                    f"{c}_dow": F.weekday(t)})
    return set_columns(df, new)


def total_value(df: DataFrame, qty: str, price: str, name: str = "Total_Value") -> DataFrame:
    """quantity x price after numeric coercion."""
    return set_columns(df, {name: to_number(qty, df.schema[qty].dataType) * to_number(price, df.schema[price].dataType)})


def feature_engineer(df: DataFrame, types: dict[str, str]) -> tuple[DataFrame, list[str]]:
    """ETL flavour: profit/margin, date parts of datetime columns, total value.

    Roles are looked up on the columns as they were before any feature was
    added; returns the frame and a log of what was added.
    """
    cols = list(df.columns)
    log = []
    rev = first_match(cols, ETL_KEYWORDS["revenue"])
    cost = first_match(cols, ETL_KEYWORDS["cost"])
    if rev and cost:
        df = add_profit(df, rev, cost, "etl")
        log.append(f"profit:{rev}-{cost}")
    dt = [c for c, t in types.items() if t == "datetime" and c in df.columns]
    if dt:
        df = date_parts(df, dt)
        log += [f"date_parts:{c}" for c in dt]
    qty = first_match(cols, ETL_KEYWORDS["qty"])
    price = first_match(cols, ETL_KEYWORDS["price"])
    if qty and price:
        df = total_value(df, qty, price)
        log.append(f"total_value:{qty}*{price}")
    return df, log
