"""Column-role detection by name keywords.

A role is the first column, in table order, whose lower-cased name contains
one of the role's keywords.  The rule is reproduced as is, traps included
(``Discount`` contains ``count``); callers can always pass roles explicitly.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame

from tabulon.operators.distinct import few_values

# Role keywords per flavour, case-insensitive substrings.
ETL_KEYWORDS = {
    "revenue": ["revenue", "sales", "income", "amount", "price"],
    "cost": ["cost", "expense", "spend", "expenditure"],
    "qty": ["qty", "units", "quantity", "count"],
    "price": ["price", "rate", "unit_price"],
}
BI_KEYWORDS = {
    "revenue": ["revenue", "sales", "income", "amount", "price", "turnover"],
    "cost": ["cost", "expense", "spend", "expenditure"],
    "date": ["date", "month", "period", "time", "year"],
    "category": ["category", "product", "region", "segment", "department", "type"],
    "qty": ["qty", "units", "quantity", "count", "volume"],
}
SQL_KEYWORDS = {
    "revenue": ["revenue", "sales", "income", "amount", "price", "total"],
    "cost": ["cost", "expense", "spend"],
    "date": ["date", "month", "period", "year", "time"],
    "qty": ["qty", "units", "quantity", "count", "volume"],
    "category": ["category", "product", "region", "segment", "department", "type", "channel"],
}
# ML target keywords (ETL flavour).
TARGET_KEYWORDS = ["target", "label", "class", "outcome", "profit", "revenue", "sales", "price", "churn", "fraud"]

# The SQL flavour accepts a category column only with at most this many distinct values.
SQL_CATEGORY_MAX_DISTINCT = 50


@dataclass
class Roles:
    revenue: str | None = None
    cost: str | None = None
    category: str | None = None
    date: str | None = None
    qty: str | None = None
    price: str | None = None
    #: the category is known to have at most SQL_CATEGORY_MAX_DISTINCT values
    category_bounded: bool = field(default=False, repr=False, compare=False)

    def as_dict(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k != "category_bounded"}


def first_match(columns: list[str], keywords: list[str]) -> str | None:
    return next((c for c in columns if any(k in c.lower() for k in keywords)), None)


def all_matches(columns: list[str], keywords: list[str]) -> list[str]:
    return [c for c in columns if any(k in c.lower() for k in keywords)]


def _bounded_category(df: DataFrame, candidates: list[str], max_distinct: int) -> str | None:
    """First candidate with at most ``max_distinct`` distinct non-null values.

    One sketch job for all candidates; only those near the bound are counted.
    """
    few = few_values(df, candidates, max_distinct)
    return next((c for c in candidates if few[c]), None)


def detect_roles(df: DataFrame, flavour: str = "sql", check_cardinality: bool = True, **override) -> Roles:
    """Detect roles from ``df.columns``; ``flavour`` is ``etl``, ``bi`` or ``sql``."""
    cols = list(df.columns)
    roles = Roles()
    if flavour == "sql":
        kw = SQL_KEYWORDS
        roles.revenue = first_match(cols, kw["revenue"])
        roles.cost = first_match(cols, kw["cost"])
        roles.date = first_match(cols, kw["date"])
        roles.qty = first_match(cols, kw["qty"])
        cands = all_matches(cols, kw["category"])
        if "category" not in override:
            roles.category = (_bounded_category(df, cands, SQL_CATEGORY_MAX_DISTINCT)
                              if check_cardinality else (cands[0] if cands else None))
            roles.category_bounded = check_cardinality and roles.category is not None
    elif flavour == "bi":
        kw = BI_KEYWORDS
        for role in ("revenue", "cost", "date", "category", "qty"):
            setattr(roles, role, first_match(cols, kw[role]))
    elif flavour == "etl":
        kw = ETL_KEYWORDS
        for role in ("revenue", "cost", "qty", "price"):
            setattr(roles, role, first_match(cols, kw[role]))
    else:
        raise ValueError(f"unknown flavour {flavour!r}")
    for k, v in override.items():
        setattr(roles, k, v)
    return roles


def detect_target(columns: list[str], numeric_columns: list[str]) -> str | None:
    """M1: first column matching a target keyword, else the last numeric column."""
    hit = first_match(columns, TARGET_KEYWORDS)
    if hit:
        return hit
    return numeric_columns[-1] if numeric_columns else None
