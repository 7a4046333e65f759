"""Type-name functions (X-16 shortening and the comparison form)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Long type names and the short forms used in artifacts.
SHORT_NAMES = {
    "timestamp with time zone": "timestamptz",
    "time with time zone": "timetz",
    "timestamp without time zone": "timestamp",
    "time without time zone": "time",
    "character": "char",
}


def trim_blank(value: Column) -> Column:
    """Without spaces and tabs at both ends."""
    return F.regexp_replace(value, r"^[ \t]+|[ \t]+$", "")


def shorten_type(value: Column) -> Column:
    """Short form of a type name; names that have none, and modifiers, pass unchanged (X-16)."""
    pairs = [F.lit(x) for pair in SHORT_NAMES.items() for x in pair]
    exact = F.create_map(*pairs)[value]
    prefixed = F.regexp_replace(F.regexp_replace(value, r"^character varying", "varchar"), r"^character\(", "char(")
    return F.coalesce(exact, prefixed)


def comparable_type(value: Column) -> Column:
    """Trimmed, lower-case, shortened: the form in which two deliveries' types are compared."""
    return shorten_type(F.lower(trim_blank(value)))


def shorten_type_sql(expression: str) -> str:
    """The same in SQL text that both Spark and DuckDB run."""
    cases = " ".join(f"WHEN '{long}' THEN '{short}'" for long, short in SHORT_NAMES.items())
    return rf"CASE {expression} {cases} ELSE regexp_replace(regexp_replace({expression}, '^character varying', 'varchar'), '^character[(]', 'char(') END"
