"""The ad-hoc gate: what reads is kept, everything else is refused."""

import pytest
from pyspark.sql import functions as F

from tabulon.plans import adhoc

READS = [
    "SELECT t.a, sum(t.b) AS s FROM t JOIN u USING (k) WHERE t.a > 1 GROUP BY ROLLUP(t.a) HAVING sum(t.b) > 2 ORDER BY s LIMIT 3 OFFSET 2;",
    "WITH x AS (SELECT 1 a), y(z) AS (SELECT a FROM x) SELECT * FROM x, y WHERE EXISTS (SELECT 1 FROM y WHERE y.z = x.a) "
    "AND a IN (SELECT z FROM y) AND (SELECT max(z) FROM y) = 1",
    "SELECT DISTINCT a, sum(b) OVER w FROM t WINDOW w AS (PARTITION BY b ORDER BY c ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)",
    "SELECT a FROM t UNION ALL SELECT b FROM t INTERSECT SELECT 3 EXCEPT SELECT 5",
    "SELECT * FROM t TABLESAMPLE (10 PERCENT) LATERAL VIEW explode(array(1, 2)) e AS z",
    "SELECT * FROM range(10) r, LATERAL (SELECT r.id + 1)", "VALUES (1, 'a'), (2, 'b')", "VALUES (1, upper('a'))", "TABLE t",
    "SELECT /*+ BROADCAST(u) */ * FROM t JOIN u ON t.k = u.k", "SELECT * FROM t PIVOT (sum(a) FOR b IN (1 AS x, 2))",
    "SELECT * FROM t UNPIVOT (v FOR n IN (a, b))", "SELECT a FROM t GROUP BY GROUPING SETS ((a), ())", "SELECT a FROM t GROUP BY ALL ORDER BY ALL",
    "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 5) SELECT * FROM r", "FROM t |> WHERE a > 1 |> SELECT a",
    "SELECT count(*) FILTER (WHERE a > 1), percentile_cont(0.5) WITHIN GROUP (ORDER BY a), count(DISTINCT b) FROM t",
    "SELECT transform(array(1), x -> x + 1), CASE WHEN a > 1 THEN 1 END, CAST(a AS string), a::double, * EXCEPT (a) FROM t",
    "SELECT a FROM t DISTRIBUTE BY a SORT BY a", "SELECT * FROM (t JOIN u ON t.k = u.k) AS z(a, b, c, d, e, f)", "SELECT upper('a;b')",
    "SELECT get_json_object('{\"a\": 1}', '$.a'), xpath_int('<a>1</a>', 'a'), from_json('{}', 'a int'), regexp_extract('a', '(a)', 1)",
    "SELECT current_date(), a LIKE 'x', a RLIKE 'y', a BETWEEN 1 AND 2, interval 1 day, nullif(a, b), try_divide(a, 0) FROM t",
]
WRITES_OR_RUNS = [
    "", "SELECT", "SHOW TABLES", "DROP TABLE t", "SET a = b", "CREATE TABLE x AS SELECT 1", "INSERT INTO t SELECT 1, 2, 3", "CACHE TABLE t",
    "EXPLAIN SELECT 1", "ADD JAR 'x.jar'", "SELECT 1; SELECT 2", "BEGIN SELECT 1; END", "USE x", "DESCRIBE t", "REFRESH TABLE t",
    "WITH a AS (SELECT 1 AS x) INSERT OVERWRITE DIRECTORY '{dir}' USING parquet SELECT * FROM a",
    "FROM t INSERT OVERWRITE DIRECTORY '{dir}' USING parquet SELECT a",
    "EXECUTE IMMEDIATE 'SELECT 1'", "EXECUTE IMMEDIATE \"INSERT OVERWRITE DIRECTORY '{dir}' USING parquet SELECT 1\"",
    "SELECT reflect('java.lang.System', 'setProperty', 'gate', 'open')", "SELECT java_method('java.lang.System', 'lineSeparator')",
    "SELECT try_reflect('java.lang.System', 'lineSeparator')", "SELECT builtin.reflect('a', 'b')", "SELECT Reflect('a', 'b')",
    "SELECT 1 WHERE EXISTS (SELECT reflect('a', 'b'))", "SELECT (SELECT max(x) FROM (SELECT java_method('a', 'b') AS x))",
    "SELECT sum(a) OVER w FROM t WINDOW w AS (PARTITION BY reflect('a', 'b'))", "SELECT transform(array(1), x -> reflect('a', 'b'))",
    "SELECT a FROM t ORDER BY reflect('a', 'b')", "WITH x AS (SELECT reflect('a', 'b')) SELECT * FROM x", "SELECT * FROM range(length(reflect('a', 'b')))",
    "SELECT * FROM t LATERAL VIEW explode(array(reflect('a', 'b'))) e AS z", "VALUES (reflect('a', 'b'))",
    "SELECT * FROM parquet.`{dir}`", "SELECT * FROM csv.`/etc/passwd`", "SELECT * FROM text.`/etc/passwd` AS x", "SELECT 1 IN (SELECT value FROM text.`/etc/passwd`)",
    "SELECT TRANSFORM(a) USING 'cat' FROM t", "SELECT IDENTIFIER('refl' || 'ect')('a', 'b')", "SELECT * FROM IDENTIFIER('t')",
    "SELECT not_a_function(1)", "SELECT from_protobuf(a, 'x', '/etc/passwd') FROM t", "SELECT a_udf(a) FROM t", "SELECT * FROM sql_keywords()",
]


@pytest.fixture(scope="module")
def bound(spark):
    spark.udf.register("a_udf", lambda x: x)
    df = spark.range(4).select(F.col("id").alias("k"), F.col("id").alias("a"), (F.col("id") * 2).alias("b"))
    df.withColumn("c", F.lit(1)).createOrReplaceTempView("t")
    df.createOrReplaceTempView("u")
    yield spark
    spark.sql("DROP TEMPORARY FUNCTION a_udf")


@pytest.mark.parametrize("sql", READS)
def test_reads_are_kept(bound, sql):
    assert adhoc.is_query(sql, bound)
    if "z(a, b, c, d, e, f)" not in sql:
        bound.sql(sql.rstrip(";"))  # and Spark can plan them


@pytest.mark.parametrize("sql", WRITES_OR_RUNS)
def test_everything_else_is_refused(bound, tmp_path, sql):
    target = tmp_path / "leak"
    sql = sql.replace("{dir}", str(target))
    assert not adhoc.is_query(sql, bound)
    assert adhoc.run_custom_query(bound, sql).error == "Only SELECT queries allowed"
    assert not target.exists()


def test_tables_of_the_catalog_are_read(bound, tmp_path):
    bound.sql(f"CREATE TABLE default.gate_table USING parquet LOCATION '{tmp_path}/g' AS SELECT 1 AS x")
    try:
        assert adhoc.run_custom_query(bound, "SELECT x FROM default.gate_table").rows == [{"x": 1}]
        assert adhoc.is_query("SELECT x FROM spark_catalog.default.gate_table", bound)
    finally:
        bound.sql("DROP TABLE default.gate_table")
