"""Typed parameters: manifest, cross-check, binding (P10, P13 to P18, X-4, X-6)."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from stratalith.errors import ParameterError
from stratalith.plans.dialects import Dialect
from stratalith.plans.guard import validate
from stratalith.plans.lexer import Placeholder, code_only, placeholders

KINDS = ("string", "number", "boolean", "date", "datetime")
RESERVED = ("tenant_", "engine_")
_NAME = re.compile(r"[a-z][a-z0-9_]*")
# The shapes that date and datetime parameters have.
_SHAPES = {"date": re.compile(r"\d{4}-\d{2}-\d{2}"), "datetime": re.compile(r"\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?")}


@dataclass(frozen=True)
class Parameter:
    """Declared parameter; ``many`` takes a non-empty list."""

    name: str
    kind: str
    many: bool = False
    value: Any = None
    description: str | None = None


@dataclass(frozen=True)
class Prepared:
    """Statement with named placeholders and the parameters it takes; holds no values."""

    dialect: str
    sql: str
    parameters: tuple[Parameter, ...]

    def to_json(self) -> str:
        """Serialised without values."""
        return json.dumps({"version": 1, "dialect": self.dialect, "sql": self.sql, "parameters": [{"name": p.name, "kind": p.kind, "many": p.many} for p in self.parameters]}, sort_keys=True)


@dataclass(frozen=True)
class Bound:
    """Statement with literals, the same with driver markers, and the markers' values in order."""

    literal: str
    marked: str
    values: tuple[Any, ...]
    names: tuple[str, ...]


def fence(text: str, *tags: str) -> str | None:
    """Body of the first fenced block that has one of the tags ("" for none) (X-6)."""
    for tag in tags:
        found = re.search(rf"```{re.escape(tag)}[ \t]*\r?\n(.*?)```", text, re.S | re.I)
        if found and found[1].strip():
            return found[1].strip()
    return None


def statement_of(reply: str) -> str | None:
    """The reply's statement: a block tagged sql, else one without a tag, else the whole reply if it has no tagged block (X-6)."""
    for pattern in (r"```sql(?![\w-])\s*(.*?)```", r"```(?![A-Za-z])\s*(.*?)```"):
        found = re.search(pattern, reply, re.S | re.I)
        if found and found[1].strip():
            return found[1].strip()
    return None if re.search(r"```[A-Za-z]", reply) else reply.strip() or None


def check_value(kind: str, value: Any) -> Any:
    """The value if it is of the kind; errors never show the value."""
    right = {
        "string": lambda v: isinstance(v, str),
        "boolean": lambda v: isinstance(v, bool),
        "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v),
    }.get(kind, lambda v: isinstance(v, str) and bool(_SHAPES[kind].fullmatch(v)))
    if not right(value):
        raise ParameterError(f"the value isn't a {kind}", "INVALID_VALUE")
    return value


def check(parameter: Parameter, value: Any) -> Any:
    """As :func:`check_value`, by the parameter's cardinality."""
    if not parameter.many:
        return check_value(parameter.kind, value)
    if not isinstance(value, (list, tuple)) or not value:
        raise ParameterError(f"{parameter.name} takes a list that isn't empty", "INVALID_VALUE")
    return [check_value(parameter.kind, v) for v in value]


def parse_manifest(reply: str) -> tuple[Parameter, ...]:
    """Parameters of the reply's json block; ParameterError if there are none or one is wrong."""
    block = fence(reply, "json")
    if block is None:
        raise ParameterError("there is no manifest", "MISSING")
    try:
        listed = json.loads(block)["parameters"]
        raw = [(p["name"], p["type"], p.get("cardinality", "one"), p["value"], p.get("description")) for p in listed]
    except (ValueError, KeyError, TypeError):
        raise ParameterError("the manifest can't be read", "MALFORMED") from None
    if not raw:
        raise ParameterError("the manifest is empty", "EMPTY")
    out = []
    for name, kind, cardinality, value, description in raw:
        if kind not in KINDS or cardinality not in ("one", "many") or not isinstance(name, str):
            raise ParameterError("the manifest can't be read", "MALFORMED")
        if not _NAME.fullmatch(name):
            raise ParameterError("a parameter's name isn't in lower case with underscores", "INVALID_NAME")
        if name.startswith(RESERVED):
            raise ParameterError("a parameter's name begins with a reserved word", "RESERVED_NAME")
        parameter = Parameter(name, kind, cardinality == "many", None, description)
        out.append(Parameter(name, kind, parameter.many, check(parameter, value), description))
    return tuple(out)


def list_place(sql: str, at: Placeholder, dialect: Dialect) -> tuple[int, int, bool] | None:
    """Start, end and negation of the ``[NOT] IN (:p)`` or ``= ANY(:p)`` whose only expression the placeholder is."""
    code = code_only(sql, dialect.backslash)
    closing = re.match(r"\s*\)", code[at.end :])
    opening = re.search(r"(?i)(\bNOT\s+)?\bIN\s*\(\s*$" + (r"|=\s*ANY\s*\(\s*$" if dialect.array_lists else ""), code[: at.start])
    if not closing or not opening:
        return None
    return opening.start(), at.end + closing.end(), bool(opening[1])


def cross_check(sql: str, parameters: tuple[Parameter, ...], dialect: Dialect) -> None:
    """Every parameter occurs, every other placeholder is a tenant's, lists stand in list places."""
    found = placeholders(sql, dialect.backslash)
    names, declared = {p.name for p in found}, {p.name: p for p in parameters}
    if missing := declared.keys() - names:
        raise ParameterError(f"{len(missing)} parameters don't occur in the statement", "UNRESOLVED_PLACEHOLDER")
    if any(n not in declared and not n.startswith("tenant_") for n in names):
        raise ParameterError("the statement has a placeholder that isn't declared", "UNRESOLVED_PLACEHOLDER")
    if any(p.name in declared and declared[p.name].many and list_place(sql, p, dialect) is None for p in found):
        raise ParameterError("a list stands where one value is expected", "INVALID_LIST_CONTEXT")


def literal(value: Any, dialect: Dialect) -> str:
    """SQL literal (X-4)."""
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        if not math.isfinite(value):
            raise ParameterError("a number isn't finite", "INVALID_VALUE")
        return repr(value)
    if any(ord(c) < 32 or ord(c) == 127 for c in value):
        raise ParameterError("a text holds a control character", "INVALID_VALUE")
    text = value.replace("\\", "\\\\") if dialect.backslash else value
    doubled = text.replace("'", "\\'") if dialect.id == "spark" else text.replace("'", "''")
    return f"'{doubled}'"


def bind(prepared: Prepared, values: Mapping[str, Any], dialect: Dialect) -> Bound:
    """Both forms of the statement for these values (P16, W4). Tenant placeholders stay."""
    known = {p.name: p for p in prepared.parameters}
    if unknown := values.keys() - known.keys():
        raise ParameterError(f"{len(unknown)} values are for no parameter", "UNKNOWN_PARAMETER")
    cross_check(prepared.sql, prepared.parameters, dialect)
    ready = {}
    for name, parameter in known.items():
        if name not in values:
            raise ParameterError(f"there is no value for {name}", "MISSING_VALUE")
        ready[name] = check(parameter, values[name])
    texts: dict[bool, list[str]] = {True: [], False: []}
    order: list[Any] = []
    names: list[str] = []
    at = 0
    for found in placeholders(prepared.sql, dialect.backslash):
        if found.name not in known:
            continue
        value, many = ready[found.name], known[found.name].many
        start, end = found.start, found.end
        if many:
            start, end, negated = list_place(prepared.sql, found, dialect)
            word = "NOT IN" if negated else "IN"
            plain = f"{word} ({', '.join(literal(v, dialect) for v in value)})"
            items = [value] if dialect.array_lists else list(value)
            marks = [dialect.mark(len(order) + i) for i in range(len(items))]
            marked = f"{'<> ALL' if negated else '= ANY'}({marks[0]})" if dialect.array_lists else f"{word} ({', '.join(marks)})"
        else:
            items = [value]
            plain, marked = literal(value, dialect), dialect.mark(len(order))
        order += items
        names += [found.name] * len(items)
        for form, piece in ((True, plain), (False, marked)):
            texts[form] += [prepared.sql[at:start], piece]
        at = end
    tail = prepared.sql[at:]
    return Bound(validate("".join(texts[True]) + tail, dialect), validate("".join(texts[False]) + tail, dialect), tuple(order), tuple(names))
