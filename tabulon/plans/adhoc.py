"""Ad-hoc read-only SQL over loaded tables.

Statements are planned by Spark SQL (Catalyst); this module only checks that
the text is a query made of nodes and functions known to be harmless, binds
the tables as temp views, makes the sides of INTERSECT and EXCEPT distinct before they meet and caps what is returned.  The full row count is a separate ``count()`` of the same plan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

ROW_CAP = 200

_CATALYST = "org.apache.spark.sql.catalyst."
#: Plan nodes a query may be made of; every other node (commands, inserts, scripts, EXECUTE IMMEDIATE, names made at run time) is refused.
PLAN_NODES = {
    _CATALYST + package + name for package, names in {
        "analysis.": "UnresolvedRelation UnresolvedHaving UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction "
                     "UnresolvedInlineTable RelationTimeTravel",
        "expressions.": "PipeOperator",
        "plans.logical.": "Aggregate Deduplicate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit "
                          "LocalRelation Offset OneRowRelation Pivot Project RepartitionByExpression Sample Sort SubqueryAlias Tail "
                          "Union Unpivot UnresolvedHint UnresolvedWith Window WithWindowDefinition"}.items() for name in names.split()}
#: What expressions may be: Spark's own ones, and names that are looked up in the query's own tables or below.
EXPRESSION_PACKAGE = re.compile(re.escape(_CATALYST) + r"expressions\.(aggregate\.|xml\.|variant\.)?\w+\$?")
NAMES = {_CATALYST + "analysis." + name for name in (
    "UnresolvedAlias", "UnresolvedAttribute", "UnresolvedExtractValue", "UnresolvedFunction", "UnresolvedGenerator", "UnresolvedOrdinal",
    "UnresolvedRegex", "UnresolvedStar", "UnresolvedStarExceptOrReplace", "MultiAlias", "UnresolvedSubqueryColumnAliases")}
REFUSED_EXPRESSIONS = {_CATALYST + "expressions." + name for name in (
    "CallMethodViaReflection", "TryReflect", "PythonUDF", "PythonUDAF", "PythonUDTF", "UnresolvedPolymorphicPythonUDTF", "ScalaUDF")}
#: Built-in functions that call any JVM method or read a file named in an argument.
REFUSED_FUNCTIONS = {"reflect", "try_reflect", "java_method", "from_protobuf", "to_protobuf"}
TABLE_FUNCTIONS = {"range", "explode", "explode_outer", "inline", "inline_outer", "posexplode", "posexplode_outer", "stack", "json_tuple",
                   "variant_explode", "variant_explode_outer"}


def is_query(sql: str, spark: SparkSession | None = None) -> bool:
    """G1: one statement that only reads tables of the session through Spark's own functions."""
    spark = spark or SparkSession.active()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.strip().rstrip(";"))
    except (PySparkException, Py4JJavaError):
        return False
    return refusal(spark, plan) is None


def _within(value, kinds):
    """What a plan node, an expression or one of their arguments (pairs, options, window definitions, ...) holds."""
    if kinds["many"].isInstance(value):
        return value.iterator()
    return value.productIterator() if kinds["product"].isInstance(value) and not kinds["type"].isInstance(value) else None


def refusal(spark: SparkSession, plan) -> str | None:
    """The first thing in a parsed plan that the gate doesn't know as harmless, or None.

    The visitor goes through every argument of every node, so subqueries, window definitions, hints and table function
    arguments are seen wherever they stand.
    """
    loader = plan.getClass().getClassLoader()
    kinds = {k: loader.loadClass(v) for k, v in {
        "tree": _CATALYST + "trees.TreeNode", "plan": _CATALYST + "plans.logical.LogicalPlan", "many": "scala.collection.Iterable",
        "product": "scala.Product", "type": "org.apache.spark.sql.types.DataType"}.items()}
    todo = [plan]
    while todo:
        node = todo.pop()
        if not hasattr(node, "getClass"):
            continue                                 # text and numbers arrive as Python values
        name = node.getClass().getName()
        if kinds["plan"].isInstance(node):
            if name.rstrip("$") not in PLAN_NODES:
                return name
            if name.endswith(".UnresolvedTableValuedFunction") and _parts(node.name())[-1].lower() not in TABLE_FUNCTIONS:
                return f"table function {_parts(node.name())}"
            if name.endswith(".UnresolvedRelation") and not _known_relation(spark, _parts(node.multipartIdentifier())):
                return f"relation {_parts(node.multipartIdentifier())}"
        elif kinds["tree"].isInstance(node):
            if name in REFUSED_EXPRESSIONS or not (name in NAMES or EXPRESSION_PACKAGE.fullmatch(name)):
                return name
            if name.endswith(".UnresolvedFunction") and not _known_function(spark, _parts(node.nameParts())):
                return f"function {_parts(node.nameParts())}"
            if name.endswith(".UnresolvedGenerator") and node.name().funcName().lower() not in TABLE_FUNCTIONS:
                return f"table function {node.name().funcName()}"
        inner = _within(node, kinds)
        while inner is not None and inner.hasNext():
            todo.append(inner.next())
    return None


def _parts(seq) -> list[str]:
    return [seq.apply(i) for i in range(seq.size())]


def _known_relation(spark: SparkSession, parts: list[str]) -> bool:
    """A plain name (a bound view, a CTE, a table of the current schema), or a table that the catalog has.

    A format and a path (parquet.`/data`) is neither.
    """
    if len(parts) == 1:
        return True
    try:
        return spark.catalog.tableExists(".".join("`" + p.replace("`", "``") + "`" for p in parts))
    except PySparkException:
        return False


def _known_function(spark: SparkSession, parts: list[str]) -> bool:
    """A function that Spark itself brings, under its own name."""
    if len(parts) > 1:
        return False
    identifier = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(parts[-1])
    found = spark._jsparkSession.sessionState().functionRegistry().lookupFunction(identifier)
    return parts[-1].lower() not in REFUSED_FUNCTIONS and found.isDefined() and found.get().getSource() == "built-in"


def bind(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def _distinct_sides(spark: SparkSession, plan):
    """INTERSECT and EXCEPT of distinct sides: the same rows, but each task hands on a value once instead of every row of it."""
    inner = plan.children()
    if not inner.size():
        return plan
    logical = spark._jvm.org.apache.spark.sql.catalyst.plans.logical
    sides = [_distinct_sides(spark, inner.apply(i)) for i in range(inner.size())]
    if plan.getClass().getSimpleName() in ("Intersect", "Except") and not plan.isAll():
        sides = [logical.Distinct(side) for side in sides]
    return plan.withNewChildren(spark._jvm.PythonUtils.toSeq(sides))


def query(spark: SparkSession, sql: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Check, bind and plan; returns the lazy result (the whole result, no cap)."""
    if not is_query(sql, spark):
        raise ValueError("Only SELECT queries allowed")
    if tables:
        bind(spark, tables)
    sql = sql.strip().rstrip(";")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    mended = _distinct_sides(spark, plan)
    if mended.equals(plan):
        return spark.sql(sql)
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, mended), spark)


@dataclass
class AdhocResult:
    columns: list[str]
    rows: list[dict]
    row_count: int
    error: str | None = None
    frame: DataFrame | None = None


def run_custom_query(spark: SparkSession, sql: str, tables: dict[str, DataFrame] | None = None,
                     row_cap: int = ROW_CAP) -> AdhocResult:
    """First ``row_cap`` rows as a preview, full row count, the whole result as a frame; error as a value."""
    try:
        df = query(spark, sql, tables)
        got = df.limit(row_cap + 1).collect()
        n = len(got) if len(got) <= row_cap else df.count()     # a second run only past the cap
        return AdhocResult(df.columns, [r.asDict() for r in got[:row_cap]], n, frame=df)
    except Exception as exc:  # error as value, like the reference
        return AdhocResult([], [], 0, str(exc).strip().splitlines()[0])
