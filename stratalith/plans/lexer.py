"""One tokenizer for all text checks on statements (X-1 to X-5)."""

from __future__ import annotations

import re
from dataclasses import dataclass

_SPAN = r"""
    (?P<text>'(?:[^']|'')*(?:'|\Z))
  | (?P<name>"(?:[^"]|"")*(?:"|\Z) | `(?:[^`]|``)*(?:`|\Z) | \[[^\]]*(?:\]|\Z))
  | (?P<dollar>\$(?P<tag>[A-Za-z_]\w*|)\$.*?(?:\$(?P=tag)\$|\Z))
"""
_PLAIN = re.compile(_SPAN, re.S | re.X)
_BACKSLASH = re.compile(_SPAN.replace(r"(?:[^']|'')*", r"(?:[^'\\]|\\.|'')*"), re.S | re.X)
_PLACEHOLDER = re.compile(r"(?<![:\w]):([a-z][a-z0-9_]*)")


@dataclass(frozen=True)
class Span:
    """Stretch of a statement: code, text, name or dollar."""

    kind: str
    start: int
    end: int


@dataclass(frozen=True)
class Placeholder:
    """``:name`` outside quotes."""

    name: str
    start: int
    end: int


def spans(sql: str, backslash: bool = False) -> list[Span]:
    """Quoted stretches and the code between them, in order and without gaps."""
    out, at = [], 0
    for found in (_BACKSLASH if backslash else _PLAIN).finditer(sql):
        if found.lastgroup is None:
            continue
        if found.start() > at:
            out.append(Span("code", at, found.start()))
        kind = next(k for k in ("text", "name", "dollar") if found.group(k) is not None)
        out.append(Span(kind, found.start(), found.end()))
        at = found.end()
    if at < len(sql):
        out.append(Span("code", at, len(sql)))
    return out


def code_only(sql: str, backslash: bool = False, names: bool = False) -> str:
    """Statement with literals (and quoted names unless ``names``) blanked, same length."""
    parts = []
    for span in spans(sql, backslash):
        piece = sql[span.start : span.end]
        parts.append(piece if span.kind == "code" or names and span.kind == "name" else " " * len(piece))
    return "".join(parts)


def placeholders(sql: str, backslash: bool = False) -> list[Placeholder]:
    """All ``:name`` in source order; a cast ``x::date`` is none."""
    return [Placeholder(m[1], m.start(), m.end()) for m in _PLACEHOLDER.finditer(code_only(sql, backslash))]


def tenant_placeholders(sql: str) -> list[Placeholder]:
    """Those of the form ``:tenant_<root>_ids``."""
    return [p for p in placeholders(sql) if re.fullmatch(r"tenant_[a-z0-9_]+_ids", p.name)]


def same_statement(a: str, b: str) -> bool:
    """Equal but for case, spacing and a closing semicolon (X-5)."""
    canonical = lambda s: re.sub(r"\s+", " ", re.sub(r";\s*$", "", s.strip())).strip().lower()
    return canonical(a) == canonical(b)
