"""What a statement would do, read off the tree that Spark's own parser makes of it.

A list of words can only guess; the tree has a node for every table, function, command and script of the
statement, whatever quotes, comments and hints stand around them. The statement is parsed, never run.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from py4j.java_gateway import is_instance_of
from pyspark.errors import ParseException
from pyspark.sql import SparkSession

from tally.functions.sqltext import NOT_SELECT

LOGICAL = "org.apache.spark.sql.catalyst.plans.logical."
# Functions that run code of the JVM, and functions in place of a table that make rows from their arguments alone.
REFLECTIVE = frozenset({"reflect", "java_method", "try_reflect"})
ROW_MAKERS = frozenset({"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack"})

SCRIPT = "scripts are not allowed"
COMPUTED = "names of tables and functions must be written out"


def _items(seq) -> Iterator:
    for i in range(seq.size()):
        yield seq.apply(i)


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _nodes(plan) -> Iterator:
    """Every plan node, those of subqueries and of named subqueries included."""
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        yield node
        waiting += [*_items(node.children()), *_items(node.innerChildren())]


def _expressions(node) -> Iterator:
    waiting = list(_items(node.expressions()))
    while waiting:
        e = waiting.pop()
        yield e
        waiting += list(_items(e.children()))


def _parts(seq) -> list[str]:
    return [str(p) for p in _items(seq)]


def _named_here(nodes: Iterable) -> set[str]:
    """Names that the statement itself gives to subqueries."""
    return {str(r._1()).lower() for n in nodes if _kind(n) == "UnresolvedWith" for r in _items(n.cteRelations())}


def refused_by_plan(spark: SparkSession, sql: str, tables: Iterable[str]) -> str:
    """Why the statement may not run over ``tables``; empty where it may. A statement that cannot be parsed is left to fail as it runs."""
    try:
        nodes = list(_nodes(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)))
    except ParseException:
        return ""
    gateway = spark.sparkContext._gateway
    known = {t.lower() for t in tables} | _named_here(nodes)
    for node in nodes:
        kind = _kind(node)
        if any(is_instance_of(gateway, node, LOGICAL + c) for c in ("Command", "ParsedStatement")):
            return NOT_SELECT
        if kind == "ScriptTransformation":
            return SCRIPT
        if kind.startswith("PlanWithUnresolvedIdentifier"):
            return COMPUTED
        if kind == "UnresolvedRelation":
            name = _parts(node.multipartIdentifier())
            if len(name) != 1 or name[0].lower() not in known:
                return f"'{'.'.join(name)}' is not one of the listed tables"
        if kind == "UnresolvedTableValuedFunction":
            name = _parts(node.name())
            if len(name) != 1 or name[0].lower() not in ROW_MAKERS:
                return f"'{'.'.join(name)}' is not one of the listed tables"
        for e in _expressions(node):
            if _kind(e).startswith("ExpressionWithUnresolvedIdentifier"):
                return COMPUTED
            if _kind(e) == "UnresolvedFunction" and _parts(e.nameParts())[-1].lower() in REFLECTIVE:
                return f"'{_parts(e.nameParts())[-1].lower()}' is not permitted (it runs code of the JVM)"
    return ""
