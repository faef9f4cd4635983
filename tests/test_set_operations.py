"""The sides of INTERSECT and EXCEPT are made distinct before they meet."""

from pyspark.sql import functions as F

from tabulon.plans import adhoc

SQL = """SELECT a FROM set_t WHERE b < 3 INTERSECT SELECT a FROM set_t WHERE b > 5
UNION SELECT b FROM set_t WHERE a = 1 EXCEPT SELECT a FROM set_t WHERE a = 2"""


def test_sides_are_distinct(spark):
    t = spark.range(3000).select((F.col("id") % 5).alias("a"), (F.col("id") % 8).alias("b"))
    t = t.union(spark.createDataFrame([(None, 0), (None, 7)], "a long, b long"))
    got = adhoc.query(spark, SQL, {"set_t": t})
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.sql(SQL).collect()))
    count = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [")
    assert count(got) >= count(spark.sql(SQL)) + 2
    assert adhoc.run_custom_query(spark, SQL).row_count == got.count()


def test_all_keeps_repeats(spark):
    spark.createDataFrame([(1,), (1,), (1,), (2,)], "a long").createOrReplaceTempView("set_u")
    got = adhoc.query(spark, "SELECT a FROM set_u INTERSECT ALL SELECT a FROM VALUES (1), (1), (3) AS v(a)")
    assert [r.a for r in got.collect()] == [1, 1]
    assert [r.a for r in adhoc.query(spark, "SELECT a FROM set_u EXCEPT ALL SELECT 1 AS a ORDER BY a").collect()] == [1, 1, 2]
