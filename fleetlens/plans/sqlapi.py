"""Ad-hoc SQL over the telemetry views: reads only, and only those views."""

from __future__ import annotations

from collections.abc import Iterator

from py4j.java_gateway import JavaObject
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

# Statements that only tell something, functions that run code of the JVM by name, nodes of a parsed query, and
# table functions that read nothing.
TELLING = ("ShowTables", "ShowTablesCommand", "ShowColumns", "ShowColumnsCommand", "DescribeRelation", "DescribeTableCommand", "DescribeQueryCommand", "ExplainCommand")
RUNNING = ("reflect", "java_method", "try_reflect")
READING = (
    "Aggregate", "AsOfJoin", "CTERelationDef", "Deduplicate", "Distinct", "Except", "Expand", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin", "Limit", "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "Pivot", "Project", "Repartition", "RepartitionByExpression", "Sample", "Sort",
    "SubqueryAlias", "Tail", "Union", "UnionLoop", "Unpivot", "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable", "UnresolvedNamespace", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedTableOrView", "UnresolvedTableValuedFunction", "Window", "WithWindowDefinition", "CurrentNamespace",
)
MAKING = ("range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple", "variant_explode", "variant_explode_outer")


class NotAllowed(AnalysisException):
    """The text is more than a read of the given views."""


def _seq(java: JavaObject) -> Iterator[JavaObject]:
    it = java.iterator()
    while it.hasNext():
        yield it.next()


def _name(node: JavaObject) -> str:
    return node.getClass().getSimpleName().rstrip("$")


class _Guard:
    """Walks a parsed plan, its subqueries and its named subqueries, before anything is resolved."""

    def __init__(self, views: set[str]) -> None:
        self.views = {v.lower() for v in views}

    def relation(self, parts: list[str], named: frozenset[str]) -> None:
        if len(parts) != 1 or parts[0].lower() not in self.views | named:
            raise NotAllowed(f"{'.'.join(parts)} is none of the relations that may be read: {', '.join(sorted(self.views))}")

    def expression(self, e: JavaObject) -> None:
        if _name(e) == "UnresolvedFunction":
            parts = [str(p).lower() for p in _seq(e.nameParts())]
            if parts[-1] in RUNNING:
                raise NotAllowed(f"{parts[-1]} runs code by name")
        for child in _seq(e.children()):
            self.expression(child)

    def plan(self, node: JavaObject, named: frozenset[str] = frozenset()) -> None:
        kind = _name(node)
        if kind == "UnresolvedWith":
            for alias in _seq(node.cteRelations()):
                # a name counts for those after it, and for itself where it is recursive
                named = named | {str(alias._1()).lower()}
                self.plan(alias._2(), named)
            self.plan(node.child(), named)
            return
        if kind in ("UnresolvedRelation", "UnresolvedTableOrView"):
            self.relation([str(p) for p in _seq(node.multipartIdentifier())], named)
        elif kind == "UnresolvedTableValuedFunction":
            parts = [str(p).lower() for p in _seq(node.name())]
            if parts[-1] not in MAKING:
                raise NotAllowed(f"{parts[-1]} is no table function that may be used")
        elif kind == "ExplainCommand":
            self.plan(node.logicalPlan(), named)
        elif kind == "DescribeQueryCommand":
            self.plan(node.plan(), named)
        # what is not known to only read is refused
        elif kind not in READING and kind not in TELLING:
            raise NotAllowed(f"{kind}: reads only")
        for e in _seq(node.expressions()):
            self.expression(e)
        for below in (*_seq(node.subqueries()), *_seq(node.children())):
            self.plan(below, named)


def checked(spark: SparkSession, sql: str, views: set[str]) -> str:
    """The kind of the statement, if it reads nothing but the views; else NotAllowed, or a syntax error."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    _Guard(views).plan(plan)
    return _name(plan)


def query(spark: SparkSession, sql: str, views: dict[str, DataFrame] | None = None) -> DataFrame:
    """Runs one statement over the views: a query, or SHOW TABLES, SHOW COLUMNS, DESCRIBE and EXPLAIN.

    The parsed plan decides: inserts, DDL, several statements, other catalogs, files by path and functions that run
    code are refused before anything is resolved. Views of the session that have the same names are there again
    afterwards.
    """
    views = views or {}
    if checked(spark, sql, set(views)) in ("ShowTables", "ShowTablesCommand"):
        # only the views are shown, not what else the session has
        return spark.createDataFrame([(name,) for name in sorted(views)], "table_name string")
    before = {name: spark.table(name) for name in views if spark.catalog.tableExists(name) and spark.catalog.getTable(name).isTemporary}
    try:
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        return spark.sql(sql)
    finally:
        for name in views:
            spark.catalog.dropTempView(name)
            if name in before:
                before[name].createOrReplaceTempView(name)
