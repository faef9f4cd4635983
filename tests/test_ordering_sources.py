import os
import tempfile

from pyspark.sql import functions as F

from tabulon.operators import ordering as O
from tabulon.sources import csv as R
from tabulon.sources import sinks as K


def test_forward_fill_leading_null_stays(spark):
    rows = [(i, None if i in (0, 1, 5, 6, 7, 30) else i * 10) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(5)
    out = {r["k"]: r["v"] for r in O.forward_fill(df, ["v"], "k", num_partitions=6).collect()}
    assert out[0] is None and out[1] is None
    assert out[5] == 40 and out[7] == 40 and out[30] == 290 and out[39] == 390


def test_row_index_contiguous_with_hot_key(spark):
    # a third of the rows share one key; the tie-break still spreads them
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id")).alias("k"))
    out = O.row_index(df, "k", num_partitions=7)
    idx = sorted(r["row_index"] for r in out.collect())
    assert idx == list(range(3000))
    first = out.orderBy("row_index").limit(3).collect()
    assert [r["k"] for r in first] == [1, 2, 4]


def test_page_and_search(spark, demo):
    assert [r["Product"] for r in O.page(demo, ["Revenue"], 1, 3).collect()] == ["Webcam HD", "SSD 1TB", "Headphones"]
    assert O.search(demo, "  LAPTOP ").count() == 3


def _write(path, data: bytes):
    with open(path, "wb") as fh:
        fh.write(data)


def test_lenient_csv(spark):
    d = tempfile.mkdtemp(prefix="tabulon-csv-")
    p = os.path.join(d, "f.csv")
    _write(p, b"a;b;c\n1;x;2.5\n2;y\n3;z;4.5;extra\n4;\"q;r\";NA\n5;N/A;\n")
    assert R.detect_delimiter(open(p).read()) == ";"
    df = R.read_csv(spark, p)
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "string", "double"]
    rows = {r["a"]: r for r in df.collect()}
    assert sorted(rows) == [1, 2, 4, 5]
    assert rows[2]["c"] is None and rows[4]["b"] == "q;r" and rows[5]["b"] is None


def test_encoding_and_names(spark):
    d = tempfile.mkdtemp(prefix="tabulon-csv-")
    p = os.path.join(d, "l.csv")
    _write(p, b"id,my name,amt $\n1,caf\xe9,2\n")
    assert R.detect_encoding(spark, p) == "latin-1"
    df = R.read_csv(spark, p, clean_names=True)
    assert df.columns == ["id", "my_name", "amt__"]
    assert df.first()["my_name"] == "café"
    assert R.safe_names(["a b", "a_b", " x "]) == ["a_b", "a_b_2", "x"]
    assert R.detect_delimiter("a|b|c\n1|2,3|4") == "|"
    assert R.detect_delimiter("a,b;c") == ","


def test_sinks_roundtrip(spark, demo):
    d = tempfile.mkdtemp(prefix="tabulon-out-")
    K.write_csv(demo, os.path.join(d, "q"), quote_all=True)
    text = "".join(open(os.path.join(d, "q", f)).read() for f in os.listdir(os.path.join(d, "q")) if f.endswith(".csv"))
    assert '"Laptop Pro"' in text
    back = R.read_csv(spark, os.path.join(d, "q"))
    assert back.count() == 16 and back.schema["Revenue"].dataType.simpleString() == "bigint"
    K.save_table(demo, path=os.path.join(d, "t"))
    assert spark.read.parquet(os.path.join(d, "t")).count() == 16
