"""Read-only checks on statements: by text for the stable codes, by Catalyst's own plan for certainty."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import ParseException
from pyspark.sql import SparkSession

from stratalith.errors import StatementError
from stratalith.plans.dialects import DIALECTS, Dialect
from stratalith.plans.lexer import code_only

# Verbs that a read-only statement can't hold outside quotes.
BANNED = ("insert", "update", "delete", "drop", "truncate", "alter", "create", "grant", "revoke", "vacuum", "analyze", "copy", "call")
CHECKS = ("not_empty", "one_statement", "no_comments", "select_or_with", "no_write_words")
#: Parsed operators that a query may consist of; anything else is refused.
ALLOWED_NODES = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Deduplicate Union Intersect Except Join LateralJoin SubqueryAlias UnresolvedSubqueryColumnAliases "
    "UnresolvedRelation UnresolvedWith CTERelationRef UnresolvedHaving UnresolvedHint OneRowRelation Generate Pivot Unpivot UnresolvedInlineTable WithWindowDefinition Window "
    "UnresolvedTableValuedFunction UnresolvedTVFAliases Tail Sample AsOfJoin WithCTE UnionLoop UnionLoopRef RecursiveUnion Values LocalRelation NamedParametersQuery".split()
)
ALLOWED_TABLE_FUNCTIONS = frozenset({"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple", "variant_explode", "variant_explode_outer"})
BANNED_FUNCTIONS = frozenset({"reflect", "java_method", "try_reflect", "input_file_name", "raise_error", "from_protobuf", "to_protobuf"})


@dataclass(frozen=True)
class Explanation:
    """What an accepted statement was checked for."""

    kind: str
    checks: tuple[str, ...]
    note: str


def verdict(sql: str | None, dialect: Dialect = DIALECTS["spark"]) -> str | None:
    """Code of the first rule that the text breaks, or None."""
    text = (sql or "").strip()
    if not text:
        return "SQL_EMPTY"
    code = code_only(text, dialect.backslash)
    if len([part for part in _parts(text, dialect) if part]) > 1:
        return "SQL_MULTI_STATEMENT"
    if "--" in code or "/*" in code:
        return "SQL_COMMENT"
    head = re.match(r"[\s(]*([A-Za-z]*)", code)[1].lower()
    if head not in ("select", "with"):
        return "SQL_NOT_SELECT_OR_WITH"
    if re.search(r"\b(?:" + "|".join((*BANNED, *dialect.banned)) + r")\b", code, re.I):
        return "SQL_FORBIDDEN_KEYWORD"
    return None


def _parts(text: str, dialect: Dialect) -> list[str]:
    """Statements between semicolons outside quotes."""
    code, parts, at = code_only(text, dialect.backslash), [], 0
    for found in re.finditer(";", code):
        parts.append(text[at : found.start()].strip())
        at = found.end()
    return [*parts, text[at:].strip()]


_SAID = {
    "SQL_EMPTY": "there is no statement",
    "SQL_MULTI_STATEMENT": "there is more than one statement",
    "SQL_COMMENT": "comments aren't taken",
    "SQL_NOT_SELECT_OR_WITH": "a statement begins with SELECT or WITH",
    "SQL_FORBIDDEN_KEYWORD": "a word of a writing statement stands outside quotes",
}


def validate(sql: str | None, dialect: Dialect = DIALECTS["spark"]) -> str:
    """The statement without its closing semicolon; StatementError with the rule's code otherwise."""
    code = verdict(sql, dialect)
    if code:
        raise StatementError(_SAID[code], code)
    bare = re.sub(r";\s*$", "", sql.strip()).strip()
    if dialect.check:
        dialect.check(bare)
    return bare


def explain(validated: str) -> Explanation:
    """Summary for the caller of an accepted statement."""
    head = re.match(r"[\s(]*([A-Za-z]+)", validated)[1].lower()
    return Explanation(head, CHECKS, "The text was checked by rule, the plan by node; review before acting on it.")


@dataclass(frozen=True)
class Reading:
    """What a parsed statement reads."""

    relations: tuple[str, ...]
    functions: tuple[str, ...]
    attributes: tuple[tuple[str, ...], ...] = ()
    all_columns: bool = False


def _walk(plan, seen: list) -> None:
    """All nodes of a parsed plan, with those inside CTEs and expressions."""
    seen.append(("plan", plan))
    children = plan.children()
    for i in range(children.size()):
        _walk(children.apply(i), seen)
    name = plan.getClass().getSimpleName()
    if name == "UnresolvedWith":
        pairs = plan.cteRelations()
        for i in range(pairs.size()):
            seen.append(("cte", str(pairs.apply(i)._1())))
            _walk(pairs.apply(i)._2(), seen)
    expressions = plan.expressions()
    for i in range(expressions.size()):
        _walk_expression(expressions.apply(i), seen)


def _walk_expression(expression, seen: list) -> None:
    seen.append(("expression", expression))
    name = expression.getClass().getSimpleName()
    if name in ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
        _walk(expression.plan(), seen)
    children = expression.children()
    for i in range(children.size()):
        _walk_expression(children.apply(i), seen)


def inspect(spark: SparkSession, sql: str) -> Reading:
    """Parse with Catalyst and allow only nodes of a query; StatementError otherwise.

    Needs the JVM session of classic PySpark; where there is none the statement is refused, not let through.
    """
    session = getattr(spark, "_jsparkSession", None)
    if session is None:
        raise StatementError("the plan can't be inspected in this session", "PLAN_UNAVAILABLE")
    try:
        plan = session.sessionState().sqlParser().parsePlan(sql)
    except ParseException as error:
        raise StatementError(f"not a statement: {str(error)[:200]}", "SQL_PARSE") from None
    seen: list = []
    _walk(plan, seen)
    shadowed = {name.lower() for kind, name in seen if kind == "cte"}
    relations, functions, attributes, everything = [], [], [], False
    for kind, node in seen:
        if kind == "cte":
            continue
        name = node.getClass().getSimpleName()
        if kind == "plan":
            if name not in ALLOWED_NODES:
                raise StatementError(f"{name} isn't part of a read-only query", "PLAN_NODE")
            if name == "UnresolvedRelation":
                parts = node.multipartIdentifier()
                relation = ".".join(str(parts.apply(i)) for i in range(parts.size()))
                if relation.lower() not in shadowed:
                    relations.append(relation)
            if name == "Join" and node.joinType().getClass().getSimpleName() in ("UsingJoin", "NaturalJoin"):
                if node.joinType().getClass().getSimpleName() == "NaturalJoin":
                    everything = True
                else:
                    using = node.joinType().usingColumns()
                    attributes += [(str(using.apply(i)),) for i in range(using.size())]
            if name == "UnresolvedTableValuedFunction":
                parts = node.name()
                function = ".".join(str(parts.apply(i)) for i in range(parts.size())).lower()
                if function not in ALLOWED_TABLE_FUNCTIONS:
                    raise StatementError(f"table function {function} isn't allowed", "PLAN_FUNCTION")
        elif name in ("ExpressionWithUnresolvedIdentifier", "UnresolvedExecuteImmediate"):
            raise StatementError("a name that is only known at run time isn't allowed", "PLAN_NODE")
        elif name == "UnresolvedFunction":
            parts = node.nameParts()
            function = str(parts.apply(parts.size() - 1)).lower()
            if function in BANNED_FUNCTIONS or parts.size() > 1:
                raise StatementError(f"function {function} isn't allowed", "PLAN_FUNCTION")
            functions.append(function)
        elif name == "UnresolvedAttribute":
            parts = node.nameParts()
            attributes.append(tuple(str(parts.apply(i)) for i in range(parts.size())))
        elif name.startswith("UnresolvedStar"):
            everything = True
    return Reading(tuple(dict.fromkeys(relations)), tuple(dict.fromkeys(functions)), tuple(dict.fromkeys(attributes)), everything)


def sensitive_reads(reading: Reading, tables: list[dict]) -> list[str]:
    """Ids of the sensitive columns that a statement names, or takes by a star, of the relations it reads.

    ``tables`` are those of a schema document. Names are compared without case, and with the table where a name is
    qualified by a table's own name; text in quotes and comments doesn't count. What an alias hides counts.
    """
    read = {r.split(".")[-1].lower() for r in reading.relations}
    own = {t["name"].lower() for t in tables}
    named = {(a[-2].lower() if len(a) > 1 and a[-2].lower() in own else None, part.lower()) for a in reading.attributes for part in a[-1:]}
    named |= {(None, part.lower()) for a in reading.attributes for part in a[:-1]}  # a column whose field is read
    out = []
    for t in tables:
        if t["name"].lower() in read:
            out += [c["id"] for c in t["columns"] if (t.get("sensitive") or c.get("sensitive")) and (reading.all_columns or {(None, c["name"].lower()), (t["name"].lower(), c["name"].lower())} & named)]
    return out
