"""Text functions as columns; ids in brackets are the blueprint's."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Referential actions by their one-letter catalog codes and by name.
ACTIONS = {"a": "no action", "r": "restrict", "c": "cascade", "n": "set null", "d": "set default"}
# The 32-bit FNV-1a parameters.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619


def underscore_slug(value: Column) -> Column:
    """Lower case, runs of other characters as one underscore (X-7)."""
    return F.regexp_replace(F.lower(value), "[^a-z0-9]+", "_")


def dash_slug(value: Column) -> Column:
    """The same with dashes (X-8)."""
    return F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-")


def content_hash(value: Column) -> Column:
    """SHA-256 in hex (X-9); null for null."""
    return F.sha2(value, 256)


def fnv1a(token: Column) -> Column:
    """32-bit FNV-1a over the UTF-16 units of a token (X-10)."""
    narrow = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), F.ascii)
    wide = F.transform(F.regexp_extract_all(F.hex(F.encode(token, "UTF-16BE")), F.lit("[0-9A-F]{4}"), 0), lambda h: F.conv(h, 16, 10).cast("int"))
    units = F.when(F.octet_length(token) == F.length(token), narrow).otherwise(wide)
    step = lambda h, c: (h.bitwiseXOR(c.cast("long")) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return F.aggregate(units, F.lit(FNV_OFFSET).cast("long"), step)


def plain_sql(value: Column) -> Column:
    """Canonical spacing and case of a statement, for structural equality (X-5)."""
    bare = F.regexp_replace(F.regexp_replace(value, r"^\s+|[\s;]+$", ""), r"\s+", " ")
    return F.lower(bare)


def fenced_block(value: Column, tag: str) -> Column:
    """Body of the first fenced block with the tag (X-6); null if there is none."""
    found = F.regexp_extract(value, rf"(?s)```{re.escape(tag)}[ \t]*\r?\n(.*?)```", 1)
    return F.when(F.length(found) > 0, F.trim(F.regexp_replace(found, r"^\s+|\s+$", "")))


def mentions(text: Column, name: str) -> Column:
    """Whether the name occurs as a whole word, case-sensitively (X-12)."""
    return text.rlike(rf"(^|[^a-zA-Z0-9_]){re.escape(name)}([^a-zA-Z0-9_]|$)")


def bullets(body: Column) -> Column:
    """Items of ``- `` and ``* `` lines, in order (X-14)."""
    lines = F.transform(F.split(body, "\n"), lambda line: F.trim(F.regexp_replace(line, r"^\s+|\s+$", "")))
    return F.transform(F.filter(lines, lambda line: line.rlike(r"^[-*] ")), lambda line: F.trim(F.substr(line, F.lit(3))))


def comma_list(value: Column) -> Column:
    """Trimmed, non-empty parts of a comma list (X-22)."""
    return F.filter(F.transform(F.split(value, ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def candidates(value: Column, most: int = 3) -> Column:
    """Non-empty parts between lines of three or more dashes, at most ``most`` (X-23, O7)."""
    parts = F.transform(F.split(value, r"(?m)^-{3,}\s*$"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.slice(F.filter(parts, lambda x: x != ""), 1, most)


def column_of(identifier: Column) -> Column:
    """Column part of ``table:<schema>.<table>#<column>``; empty without one (X-24)."""
    at = F.instr(identifier, "#")
    return F.when(at > 0, F.substring(identifier, at + 1, F.length(identifier))).otherwise("")


def table_of(identifier: Column) -> Column:
    """Table part of a column id (X-24)."""
    at = F.instr(identifier, "#")
    return F.when(at > 0, F.substring(identifier, F.lit(1), at - 1)).otherwise(identifier)


def table_id(schema: Column, name: Column) -> Column:
    """Stable id of a table."""
    return F.concat(F.lit("table:"), schema, F.lit("."), name)


def column_id(schema: Column, name: Column, column: Column) -> Column:
    """Stable id of a column."""
    return F.concat(table_id(schema, name), F.lit("#"), column)


def redact_url(value: Column) -> Column:
    """Scheme, host and path of a connection URL, without credentials and options (X-26); a fixed phrase for other shapes."""
    found = F.regexp_extract(value, r"^([A-Za-z][A-Za-z0-9+.-]*://)(?:[^/?#]*@)?([^/?#@]+[^?#]*)", 2)
    return F.when(value.isNotNull(), F.when(found != "", F.concat(F.regexp_extract(value, r"^([A-Za-z][A-Za-z0-9+.-]*://)", 1), found)).otherwise("configured connection"))


def schema_id_of_path(path: Column) -> Column:
    """Last part of a path without its ``.schema`` ending (X-27)."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)[/\\]*$", 1), r"\.schema$", "")


def array_literal(value: Column) -> Column:
    """Elements of ``{a,NULL,"b"}`` (X-19); an unquoted NULL is null, an empty literal an empty array."""
    inner = F.regexp_replace(value, r"^\{|\}$", "")
    raw = F.regexp_extract_all(F.concat(inner, F.lit(",")), F.lit(r'("(?:[^"\\]|\\.)*"|[^,]*),'), 1)
    plain = lambda x: F.when(x == "NULL", None).when(x.startswith('"'), F.regexp_replace(F.regexp_replace(x, r'^"|"$', ""), r"\\(.)", "$1")).otherwise(x)
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.transform(raw, plain))


def referential_action(code: Column) -> Column:
    """Action of a catalog code or phrase, in words (X-20); null if unknown or null."""
    pairs = [F.lit(x) for pair in ACTIONS.items() for x in pair]
    words = F.lower(F.translate(code, "_", " "))
    return F.coalesce(F.create_map(*pairs)[code], F.when(words.isin(list(ACTIONS.values())), words))


def is_date(value: Column) -> Column:
    """``YYYY-MM-DD`` by shape and by calendar (X-21)."""
    return value.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(value, F.lit("yyyy-MM-dd")).isNotNull()


def may_be_enum(type_name: Column) -> Column:
    """Textual types whose values could be listed."""
    name = F.lower(type_name)
    return name.isin("text", "citext") | name.startswith("varchar") | name.startswith("char") | (name.contains("enum") & ~name.endswith("[]"))


def sqlserver_type(name: Column, max_length: Column, precision: Column, scale: Column) -> Column:
    """Type with its modifiers as the engine declares it (X-17): wide types count two bytes a character, -1 is max."""
    kind = F.lower(name)
    length = F.when(max_length == -1, "max").otherwise(F.when(kind.isin("nvarchar", "nchar"), F.floor(max_length / 2)).otherwise(max_length).cast("string"))
    sized = F.concat(name, F.lit("("), length, F.lit(")"))
    exact = F.concat(name, F.lit("("), precision.cast("string"), F.lit(","), scale.cast("string"), F.lit(")"))
    return F.when(kind.isin("varchar", "char", "nvarchar", "nchar", "varbinary", "binary"), sized).when(kind.isin("decimal", "numeric"), exact).otherwise(name)


def sqlite_type(declared: Column) -> Column:
    """Declared type, BLOB if there is none (X-18)."""
    return F.coalesce(F.nullif(F.trim(declared), F.lit("")), F.lit("BLOB"))


def glob_pattern(glob: str) -> str:
    """Anchored, case-sensitive regular expression of a table glob with ``*`` and ``?`` (F2)."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def matches_globs(name: Column, globs: list[str]) -> Column:
    """Any of the globs; no globs let everything through (F2)."""
    if not globs:
        return F.lit(True)
    out = F.lit(False)
    for glob in globs:
        out = out | name.rlike(glob_pattern(glob))
    return out
