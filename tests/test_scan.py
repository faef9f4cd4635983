"""Scans of awkward files: line breaks in quotes, encodings by file, order of the rows."""

import csv as stdcsv
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.functions.numeric import ROW_ID
from tabulon.operators.ordering import scan_order
from tabulon.sources import csv, records, sinks


@pytest.fixture()
def small_splits(spark):
    """Files are cut into splits of 500 bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def awkward(rng, n):
    bits = ['"', ",", ";", "\n", "\r\n", "\\", "é", " ", "word", "x" * 40, "a\n\nb", '""', "'", "\t"]
    return [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 9))) + "z", rng.randrange(100)) for i in range(n)]


def write(path, rows, end="\r\n", encoding="utf-8"):
    out = io.StringIO()
    w = stdcsv.writer(out, lineterminator=end)
    w.writerow(["id", "text", "n"])
    w.writerows(rows)
    path.write_bytes(out.getvalue().encode(encoding))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_over_many_splits(spark, tmp_path, small_splits, end):
    rng = random.Random(7)
    rows = awkward(rng, 300) + [(300, "long " * 400 + "\n" * 900 + "end", 1)] + awkward(rng, 20)
    write(tmp_path / "a.csv", rows, end)
    write(tmp_path / "b.csv", [(i, "plain", 3) for i in range(5)], end)
    got = csv.read_csv(spark, str(tmp_path), infer=False, row_ids=True)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    want = [(str(i), t, str(n)) for i, t, n in rows] + [(str(i), "plain", "3") for i in range(5)]
    found = sorted((r[ROW_ID], r["id"], r["text"], r["n"]) for r in got.collect())
    assert [f[1:] for f in found] == want and [f[0] for f in found] == list(range(len(want)))


def test_states_follow_the_lines():
    rng = np.random.default_rng(3)
    f0, f1 = rng.random(500) < 0.2, rng.random(500) < 0.7
    for begin in (False, True):
        before, after, state = [], [], begin
        for a, b in zip(f0, f1):
            before.append(state)
            state = bool(b if state else a)
            after.append(state)
        got = records.states(f0, f1, begin)
        assert got[0].tolist() == before and got[1].tolist() == after


def test_only_files_with_open_quotes_are_cut_into_records(spark, tmp_path):
    write(tmp_path / "a.csv", [(1, "two\nlines", 1)])
    write(tmp_path / "b.csv", [(2, 'a "quoted", word', 2)])
    (tmp_path / "c.csv").write_text('id,text,n\n3,5" pipe,3\n4,"never closed,4\n5,after,5\n')  # stray quotes: line by line
    plan = {p[0].rsplit("/", 1)[-1]: part.records for part in csv.scan_plan(spark, str(tmp_path), ",") for p in [[x] for x in part.paths]}
    assert plan == {"a.csv": True, "b.csv": False, "c.csv": False}
    got = {r["id"]: r["text"] for r in csv.read_csv(spark, str(tmp_path), sep=",").collect()}
    assert got[1] == "two\nlines" and got[2] == 'a "quoted", word' and got[3] == '5" pipe' and got[5] == "after"


def test_one_plan_for_tidy_files(spark, tmp_path):
    write(tmp_path / "a.csv", [(1, "a", 1)])
    write(tmp_path / "b.csv", [(2, "b", 2)])
    assert csv.scan_plan(spark, str(tmp_path), ",") == [csv.ScanPart([str(tmp_path)], "utf-8")]


def test_encoding_by_file(spark, tmp_path):
    words = ["ñandú", "été", "plain", "größe"]
    write(tmp_path / "1 utf.csv", [(i, w, 1) for i, w in enumerate(words)])
    write(tmp_path / "2 latin.csv", [(10 + i, w, 2) for i, w in enumerate(words)], encoding="latin-1")
    write(tmp_path / "3 [latin]{x}.csv", [(20 + i, w + "\nmore", 3) for i, w in enumerate(words)], encoding="latin-1")
    got = csv.read_csv(spark, str(tmp_path), row_ids=True).orderBy(ROW_ID).collect()
    assert [r["text"] for r in got] == words + words + [w + "\nmore" for w in words]
    assert [r["id"] for r in got] == [*range(4), *range(10, 14), *range(20, 24)] and [r[ROW_ID] for r in got] == list(range(12))


@pytest.mark.parametrize("quote_all", [False, True])
def test_default_round_trip(spark, tmp_path, quote_all):
    rows = [(i, t.replace("\r\n", "\n"), n) for i, t, n in awkward(random.Random(1), 200)] + [(500, " blanks ", 1), (501, None, 2), (502, "\\", 3), (503, '"', 4)]
    df = spark.createDataFrame(rows, "id long, text string, n long").repartition(4)
    path = sinks.write_csv(df, str(tmp_path / "out"), quote_all=quote_all)
    back = csv.read_csv(spark, path, sep=",")
    assert dict(back.dtypes) == {"id": "bigint", "text": "string", "n": "bigint"}
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_lenient_rows_keep_their_order(spark, tmp_path, small_splits):
    lines = [f"{i};x{i}" + (";extra;fields" if i % 7 == 0 else "" if i % 5 else ";y") for i in range(400)]
    (tmp_path / "f.csv").write_text("a;b;c\n" + "\n".join(lines))
    got = csv.read_csv(spark, str(tmp_path), sep=";", row_ids=True).orderBy(ROW_ID)
    assert [(r[ROW_ID], r["a"]) for r in got.collect()] == list(enumerate(i for i in range(400) if i % 7))
    assert [r["a"] for r in csv.limit_rows(csv.read_csv(spark, str(tmp_path), sep=";"), 5).collect()] == [1, 2, 3, 4, 5]


def test_scan_order_of_files_and_of_other_rows(spark, tmp_path, small_splits):
    for part in range(3):
        spark.range(part * 1000, part * 1000 + 1000, 1, 1).select(F.col("id").alias("k"), (F.col("id") % 2).alias("odd")).write.parquet(f"{tmp_path}/{part}")
    df = spark.read.parquet(*[f"{tmp_path}/{p}" for p in (2, 0, 1)])
    got = scan_order(df.where("odd = 1").select("k"))
    assert got.columns == ["k", ROW_ID]
    assert [r["k"] for r in got.orderBy(ROW_ID).collect()] == list(range(1, 3000, 2))
    assert sorted(r[ROW_ID] for r in got.collect()) == list(range(1500))
    other = scan_order(spark.createDataFrame([(i,) for i in range(50, 0, -1)], "k long").repartition(1))
    assert sorted(r[ROW_ID] for r in other.collect()) == list(range(50))
    assert scan_order(spark.createDataFrame([], "k long")).count() == 0
