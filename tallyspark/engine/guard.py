"""Guards for text that callers supply: names, predicates, and whole statements.

Text is parsed by Spark's own parser and judged by its tree, never by searching words in it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]{0,127}$")
SAFE_TABLE_FUNCTIONS = frozenset({"range", "explode", "explode_outer", "posexplode", "inline", "stack", "json_tuple"})
UNSAFE_FUNCTIONS = frozenset({"reflect", "java_method", "try_reflect", "input_file_name", "raise_error", "read_files"})
_PLAN_READS = frozenset(
    "Project Filter Aggregate Sort Join Union Intersect Except Distinct GlobalLimit LocalLimit Limit UnresolvedRelation SubqueryAlias UnresolvedSubqueryColumnAliases "
    "UnresolvedWith CTE Window WithWindowDefinition OneRowRelation UnresolvedInlineTable LateralJoin Generate UnresolvedHaving Having Pivot Unpivot Sample Offset "
    "UnresolvedTableValuedFunction TableAlias ExplainCommand RepartitionByExpression LocalRelation ResolvedHint UnresolvedHint GroupingSets UnresolvedQualify Tail Expand Deduplicate WithCTE".split()
)


class GuardError(ValueError):
    """The text isn't allowed."""


def identifier(name: str) -> str:
    """A plain identifier, or GuardError."""
    if not isinstance(name, str) or not NAME.match(name):
        raise GuardError(f"not an identifier: {name!r}")
    return name


def quoted(name: str) -> str:
    """Any column name in backticks."""
    if not name or any(ord(c) < 32 for c in name):
        raise GuardError(f"not a column name: {name!r}")
    return "`" + name.replace("`", "``") + "`"


def columns(df: DataFrame, names: list[str]) -> list[str]:
    """The names, if the frame has them all."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise GuardError(f"unknown columns: {missing}; the frame has {df.columns}")
    return list(names)


def table_name(name: str) -> str:
    """A table reference of one to three identifiers."""
    parts = name.split(".")
    if len(parts) > 3:
        raise GuardError(f"not a table: {name!r}")
    return ".".join(identifier(p) for p in parts)


def predicate(spark: SparkSession, text: str) -> Column:
    """A boolean expression without subqueries and unsafe functions."""
    try:
        tree = spark._jsparkSession.sessionState().sqlParser().parseExpression(text)
    except Exception as e:  # noqa: BLE001 - py4j wraps the parser's error
        raise GuardError(f"not an expression: {text!r}") from e
    shown = tree.treeString()
    if re.search(r"(ScalarSubquery|Exists|ListQuery|InSubquery|scalar-subquery|exists#|list#)", shown):
        raise GuardError("a predicate has no subquery")
    _refuse_functions(shown)
    return F.expr(text)


def _refuse_functions(shown: str) -> None:
    for name in re.findall(r"'?`?([A-Za-z_]\w*)`?\(", shown):
        if name.lower() in UNSAFE_FUNCTIONS:
            raise GuardError(f"function {name} isn't allowed")


def _nodes(plan) -> list:
    out, stack = [], [plan]
    while stack:
        node = stack.pop()
        out.append(node)
        for group in (node.children(), node.innerChildren()):
            for k in range(group.size()):
                child = group.apply(k)
                if hasattr(child, "innerChildren"):
                    stack.append(child)
    return out


def parsed(spark: SparkSession, text: str):
    """The parsed plan of one statement."""
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:  # noqa: BLE001
        raise GuardError(f"not one statement: {str(e)[:200]}") from e


def referenced_tables(spark: SparkSession, text: str) -> list[str]:
    """Tables that a statement reads, without the names it defines itself."""
    shown = parsed(spark, text).treeString()
    names = re.findall(r"'?UnresolvedRelation \[([^\]]+)\]", shown)
    own = set(re.findall(r"(?:CTE|UnresolvedWith) \[([^\]]+)\]", shown))
    defined = {x.strip().split(" ")[0] for group in own for x in group.split(",")}
    out = []
    for n in names:
        name = ".".join(p.strip() for p in n.split(","))
        if name not in defined and name not in out:
            out.append(name)
    return out


def read_only(spark: SparkSession, text: str) -> str:
    """The statement, if it is one that only reads registered tables; else GuardError."""
    plan = parsed(spark, text)
    shown = plan.treeString()
    for node in _nodes(plan):
        name = node.nodeName().lstrip("'")
        if name.endswith("Command") and name != "ExplainCommand" or name not in _PLAN_READS and re.match(r"(Create|Drop|Insert|Update|Delete|Merge|Alter|Truncate|Replace|Set|Cache|Load|Refresh|Analyze|Script|Use|Add|Msck|Repair|Show|Describe|Call|Execute|Append|Overwrite)", name):
            raise GuardError(f"{name} isn't a read")
    if "ScriptTransformation" in shown:
        raise GuardError("TRANSFORM isn't allowed")
    for table in referenced_tables(spark, text):
        parts = table.split(".")
        if len(parts) == 2 and parts[0].lower() in {"parquet", "csv", "json", "orc", "text", "binaryfile", "avro", "delta", "jdbc"}:
            raise GuardError("files are read through sources only")
    for name in re.findall(r"UnresolvedTableValuedFunction \[?([A-Za-z_]\w*)", shown):
        if name.lower() not in SAFE_TABLE_FUNCTIONS:
            raise GuardError(f"table function {name} isn't allowed")
    _refuse_functions(shown)
    return text
