"""The four flows on a messy upload in the F-2 retail shape (hand-written rows, read through the CSV scan)."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tabulon.plans import workflows as W
from tabulon.plans.fixtures import RETAIL_COLUMNS
from tabulon.sources.csv import read_csv


@pytest.fixture(scope="module")
def retail(spark):
    rnd = random.Random(42)
    header = RETAIL_COLUMNS + ["Notes (free text)", "Empty Col"]
    lines = [",".join(header)]
    for i in range(60):
        qty = rnd.randint(1, 9)
        price = round(rnd.uniform(5, 500), 2)
        rev = round(qty * price, 2)
        cost = round(rev * rnd.uniform(0.4, 0.9), 2)
        row = [str(1000 + i), f"2024-{(i % 12) + 1:02d}-{(i % 27) + 1:02d}", ["Jan", "Feb", "Mar"][i % 3], "2024",
               rnd.choice(["Electronics", "Clothing", "Home"]), f"P{i % 7}", rnd.choice(["North", "South"]),
               rnd.choice(["Pune", "Delhi", "Lyon"]), f"C{i % 13}", str(rnd.randint(18, 70)),
               rnd.choice(["M", "F"]), rnd.choice(["Retail", "Corporate"]), str(qty), str(price), str(rev),
               str(rnd.choice([0, 5, 10])), "0", str(rev), str(cost), str(round(rev - cost, 2)),
               rnd.choice(["Card", "Cash"]), rnd.choice(["Std", "Exp"]), str(round(rnd.uniform(1, 20), 2)),
               str(round(rnd.uniform(1, 5), 1)), rnd.choice(["High", "Low"]), rnd.choice(["Yes", "No"]),
               f"note {i}", ""]
        for idx in (9, 13, 14, 16, 17, 18, 19, 22, 23):
            if rnd.random() < 0.08:
                row[idx] = ""
        lines.append(",".join(row))
    lines += lines[1:4]                      # duplicates
    d = tempfile.mkdtemp(prefix="tabulon-retail-")
    path = os.path.join(d, "retail.csv")
    with open(path, "w") as fh:
        fh.write("\n".join(lines) + "\n")
    return read_csv(spark, path)


def test_scan_types(retail):
    t = {f.name: f.dataType.simpleString() for f in retail.schema.fields}
    assert t["Order_ID"] == "bigint" and t["Date"] == "date" and t["Unit_Price"] == "double"
    assert t["Empty Col"] == "double" and t["Month"] == "string"
    assert retail.count() == 63


def test_sql_flow(retail):
    out = W.sql_pack(retail, table="retail_t", collect=True)
    assert out["roles"]["revenue"] == "Unit_Price" and out["roles"]["category"] == "Category"
    assert out["roles"]["qty"] == "Quantity"
    assert "Notes__free_text_" in out["table"].columns
    assert out["table"].count() == 60
    errors = {k: r.error for k, r in out["queries"].items() if r.error}
    assert not errors, errors


def test_bi_flow(retail):
    out = W.bi_report(retail, order_by=["Order_ID"], with_model=True)
    assert out["roles"]["revenue"] == "Unit_Price" and "Profit_Margin_%" in out["cleaned"].columns
    assert out["cleaned"].where(F.col("Unit_Price").isNull()).count() == 0
    assert out["ml"]["model"] == "Random Forest"
    assert out["chart"].count() <= 10


def test_etl_flow(retail):
    out = W.etl(retail, order_by=["Order_ID"], with_model=True)
    cleaned = out["cleaned"]
    assert "Empty Col" not in cleaned.columns and "Year" not in cleaned.columns   # empty and constant dropped
    assert "Date_year" in cleaned.columns and "Total_Value" in cleaned.columns
    assert out["stats"].count() > 5 and out["corr"].count() > 4
    assert out["ml"].target == "Unit_Price" or out["ml"].target in cleaned.columns


def test_analyst_flow(retail):
    out = W.analyst(retail, with_model=True)
    ch = out["changes"]
    assert ch["duplicates_removed"] == 3 and 0 <= ch["quality_score"] <= 100
    assert "R2" in ch["accuracy_metrics"]
    for kind in ("bar", "pie", "line", "heatmap", "scatter", "box"):
        assert W.chart(out["cleaned"], kind) is not None
