from tabulon.functions.roles import Roles, detect_roles, detect_target, first_match, SQL_KEYWORDS, ETL_KEYWORDS
from tabulon.plans.fixtures import RETAIL_COLUMNS


def test_demo_roles_sql(demo):
    r = detect_roles(demo, "sql")
    assert (r.revenue, r.cost, r.category, r.date, r.qty) == ("Revenue", "Cost", "Product", "Month", "Units")


def test_demo_roles_bi(demo):
    r = detect_roles(demo, "bi")
    assert (r.revenue, r.cost, r.category, r.date, r.qty) == ("Revenue", "Cost", "Product", "Month", "Units")


def test_retail_traps():
    # Unit_Price precedes Revenue, so it takes the revenue role; Discount_Pct contains "count".
    assert first_match(RETAIL_COLUMNS, ETL_KEYWORDS["revenue"]) == "Unit_Price"
    assert first_match(["Discount_Pct", "Quantity"], SQL_KEYWORDS["qty"]) == "Discount_Pct"
    assert first_match(RETAIL_COLUMNS, SQL_KEYWORDS["date"]) == "Date"


def test_sql_category_cardinality(spark):
    rows = [(i, f"p{i}", "A" if i % 2 else "B", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, product string, region string, sales double")
    # product has 60 distinct values (> 50), so the next keyword match wins.
    assert detect_roles(df, "sql").category == "region"
    assert detect_roles(df, "sql", check_cardinality=False).category == "product"


def test_target():
    assert detect_target(["a", "Churn_flag", "x"], ["a", "x"]) == "Churn_flag"
    assert detect_target(["a", "b"], ["a", "b"]) == "b"
    assert detect_target(["a"], []) is None
