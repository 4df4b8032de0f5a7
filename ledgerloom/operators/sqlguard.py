"""Guard for generated SQL: Spark parses it, the parsed plan is checked, and the projection is set on the plan.

Only one SELECT over the three fact tables passes: one projection over joined tables with conditions, a
filter, an order and a limit. Nodes, expressions, functions and columns are listed; all else is
refused, subqueries anywhere, cross joins and functions that are not listed included.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The tables and columns of the fact warehouse.
TABLES = ("collections", "filings", "financial_facts")
COLUMNS = (
    "collection_id", "company", "ticker", "cik", "market", "status", "filing_id", "filing_type", "fiscal_year", "fiscal_period", "filed_date", "source_url", "version", "logical_key", "fact_id", "concept", "value", "unit", "period", "dimension", "origin",
)
CANONICAL = ("fact_id", "filing_id", "concept", "value", "unit", "period", "dimension", "origin")
LIMIT = 50
NODES = {"Project", "Filter", "Join", "SubqueryAlias", "UnresolvedRelation", "GlobalLimit", "LocalLimit", "Sort"}
EXPRESSIONS = {
    "UnresolvedAttribute", "UnresolvedStar", "UnresolvedAlias", "Alias", "Literal", "SortOrder", "Cast", "CaseWhen", "And", "Or", "Not", "In", "EqualTo", "EqualNullSafe", "LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual", "IsNull", "IsNotNull", "Like", "ILike",
    "RLike", "Add", "Subtract", "Multiply", "Divide", "Remainder", "UnaryMinus", "UnaryPositive", "Between", "UnresolvedFunction", "LikeAll", "LikeAny",
}
FUNCTIONS = {
    "lower", "upper", "trim", "ltrim", "rtrim", "length", "char_length", "substring", "substr", "left", "right", "concat", "replace", "coalesce", "nullif", "ifnull", "abs", "round", "floor", "ceil", "year", "month", "quarter", "day", "extract", "date_part", "datepart",
    "to_date", "date", "greatest", "least", "between", "like", "ilike", "rlike", "regexp_like", "split_part", "startswith", "endswith", "contains", "isnull", "isnotnull", "and", "or", "not", "=", "<", ">", "<=", ">=", "<>", "!=", "+", "-", "*", "/", "%",
}


class Refused(ValueError):
    """The statement is not a permitted query."""


def from_reply(reply: str) -> str:
    """The statement in a model's reply: fences gone, from the first SELECT, without the final semicolon."""
    body = re.sub(r"```(?:sql)?", "", reply, flags=re.I)
    at = re.search(r"\bselect\b", body, re.I)
    return (body[at.start() :] if at else "").strip().rstrip(";").strip()


def _listed(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]


def _check_expression(e) -> None:
    """Refuses an expression that is not listed, and looks at what is in it."""
    kind = e.getClass().getSimpleName().rstrip("$")
    if kind not in EXPRESSIONS:
        raise Refused(f"{kind} is not permitted")
    if kind == "UnresolvedAttribute":
        name = _listed(e.nameParts())[-1]
        if name.lower() not in COLUMNS:
            raise Refused(f"unknown column {name}")
    if kind == "UnresolvedFunction":
        name = ".".join(_listed(e.nameParts())).lower()
        if name not in FUNCTIONS:
            raise Refused(f"function {name} is not permitted")
    for child in _listed(e.children()):
        _check_expression(child)


def parsed(spark: SparkSession, statement: str):
    """(plan below the projection, name of the fact table in it, limit) of a permitted statement, else Refused."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except Exception as e:
        raise Refused("not one query that Spark can parse") from e
    tables, limit, body, stack = {}, LIMIT, None, [(plan, None)]
    while stack:
        node, above = stack.pop()
        kind = node.getClass().getSimpleName()
        if kind not in NODES:
            raise Refused(f"{kind} is not permitted")
        if kind == "Project":
            if body is not None:
                raise Refused("subqueries are not permitted")
            body = node.child()
        elif kind == "SubqueryAlias" and node.child().getClass().getSimpleName() != "UnresolvedRelation":
            raise Refused("subqueries are not permitted")
        elif kind == "UnresolvedRelation":
            name = node.tableName().replace("`", "").lower()
            if name not in TABLES:
                raise Refused(f"unknown table {name}")
            tables.setdefault(name, above or name)
        elif kind == "Join":
            if node.condition().isEmpty() and node.joinType().getClass().getSimpleName() != "UsingJoin":
                raise Refused("a join needs a condition")
        elif kind in ("GlobalLimit", "LocalLimit"):
            shown = node.expressions().mkString(" ")
            limit = min(limit, int(shown)) if shown.isdigit() else limit
        for e in _listed(node.expressions()):
            _check_expression(e)
        alias = node.alias() if kind == "SubqueryAlias" else None
        stack += [(child, alias) for child in _listed(node.children())]
    if body is None or "financial_facts" not in tables:
        raise Refused("it must select from financial_facts")
    return body, tables["financial_facts"], limit


def checked(spark: SparkSession, statement: str) -> tuple[str, int]:
    """(statement, limit) if it is permitted, else Refused."""
    return statement, parsed(spark, statement)[2]


def run(spark: SparkSession, statement: str, views: dict[str, DataFrame], collection: str | None = None) -> DataFrame:
    """Facts that a permitted statement selects, in canonical columns, at most 50, of one collection if named.

    The statement's own projection and order are replaced on the parsed plan; facts are ordered by all
    columns so that the limit is defined. The tables are known to a session of their own, so no view of
    the caller's is touched.
    """
    body, source, limit = parsed(spark, statement)
    apart = spark.newSession()
    on = lambda session, plan: DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, plan), session)
    for name in TABLES:
        on(apart, views[name]._jdf.queryExecution().analyzed()).createOrReplaceTempView(name)
    rows = on(apart, body).select(*[F.col(f"{source}.{c}") for c in CANONICAL])
    rows = on(spark, rows._jdf.queryExecution().analyzed())
    if collection is not None:
        known = views["filings"].where(views["filings"]["collection_id"] == collection).select("filing_id").distinct()
        rows = rows.join(known, "filing_id", "left_semi").select(*CANONICAL)
    return rows.distinct().orderBy(*CANONICAL).limit(limit)
