"""Prompt text from a described schema."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.errors import GenerationError
from stratalith.functions.text import table_of
from stratalith.plans.dialects import Dialect

HIDDEN_TABLE = "  [this table's columns are not shown: it is sensitive]"
HIDDEN_COLUMNS = "  [no column of this table may be shown]"


def ddl_lines(tables: DataFrame, columns: DataFrame, omit: bool = False, only: DataFrame | None = None) -> DataFrame:
    """(table_position, line_no, line) of all tracked tables, in schema order.

    ``omit`` leaves out sensitive columns and stubs sensitive tables; otherwise they are tagged. ``only`` keeps the tables with
    these ids (P8). Descriptions, aliases and values of what is sensitive are never shown.
    """
    live = tables.where(F.coalesce("tracked", F.lit(True)))
    if only is not None:
        live = live.join(only.select("table_id").distinct(), "table_id", "left_semi")
    t = live.select("table_id", F.col("position").alias("table_position"), "schema", F.col("name").alias("table_name"), F.col("sensitive").alias("table_sensitive"), F.col("description").alias("table_description"), F.col("aliases").alias("table_aliases"), "common_query_language")
    c = columns.join(t.select("table_id", "table_position", "table_sensitive"), "table_id")
    hidden = F.col("sensitive") | F.col("table_sensitive")
    flags = F.concat(F.when(F.col("primary_key"), "PK ").otherwise(""), F.when(F.col("nullable"), "NULL").otherwise("NOT NULL"))
    extras = F.concat_ws("; ", F.when(F.size("aliases") > 0, F.concat(F.lit("aliases: "), F.array_join("aliases", ", "))), F.when(F.size("enum") > 0, F.concat(F.lit("values: "), F.array_join("enum", "|"))), F.when(F.col("description") != "", F.col("description")))
    tail = F.when(hidden, " (sensitive)").when(extras != "", F.concat(F.lit(" -- "), extras)).otherwise("")
    line = F.concat(F.lit("  - "), "name", F.lit(" "), "type", F.lit(" ("), flags, F.lit(")"), tail)
    shown = c.where(~hidden) if omit else c
    rows = [
        t.select("table_position", F.lit(0).alias("line_no"), F.concat(F.lit("TABLE "), F.concat_ws(".", "schema", "table_name"), F.when(~F.col("table_sensitive") & (F.size("table_aliases") > 0), F.concat(F.lit(" -- aliases: "), F.array_join("table_aliases", ", "))).otherwise("")).alias("line")),
        t.where(~F.col("table_sensitive") & (F.col("table_description") != "")).select("table_position", F.lit(1), F.concat(F.lit("-- "), "table_description")),
        shown.select("table_position", F.col("position") + 10, line),
    ]
    if omit:
        visible = shown.select("table_position").distinct()
        rows.append(t.where("table_sensitive").select("table_position", F.lit(2), F.lit(HIDDEN_TABLE)))
        rows.append(t.where("NOT table_sensitive").join(visible, "table_position", "left_anti").select("table_position", F.lit(2), F.lit(HIDDEN_COLUMNS)))
    language = t.where(~F.col("table_sensitive") & (F.col("common_query_language") != ""))
    rows.append(language.select("table_position", F.lit(1_000_000), F.lit("-- common query language --")))
    rows.append(language.select("table_position", F.posexplode(F.split("common_query_language", "\n")).alias("n", "x")).select("table_position", F.col("n") + 1_000_001, F.concat(F.lit("-- "), "x")))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionAll(more)
    return out


def ddl_stats(tables: DataFrame, columns: DataFrame, omit: bool = False) -> DataFrame:
    """One row: redacted columns, stubbed tables, listed sensitive columns, untracked tables."""
    live = tables.where(F.coalesce("tracked", F.lit(True)))
    c = columns.join(live.select("table_id", F.col("sensitive").alias("table_sensitive")), "table_id")
    of_columns = c.agg(F.count_if(F.col("sensitive") | F.col("table_sensitive")).alias("n"))
    of_tables = tables.agg(F.count_if(F.coalesce("tracked", F.lit(True)) & F.col("sensitive")).alias("stubs"), F.count_if(~F.coalesce("tracked", F.lit(True))).alias("untracked"))
    return of_columns.join(of_tables, F.lit(True)).select(
        (F.col("n") if omit else F.lit(0).cast("long")).alias("redacted_columns"), (F.col("stubs") if omit else F.lit(0).cast("long")).alias("sensitive_table_stubs"),
        (F.lit(0).cast("long") if omit else F.col("n")).alias("listed_sensitive_columns"), F.col("untracked").alias("untracked_tables"),
    )


def ddl_text(lines: DataFrame) -> str:
    """The lines of one schema as text, tables parted by a blank line."""
    out: list[str] = []
    at = None
    for row in lines.orderBy("table_position", "line_no").collect():
        if at is not None and row[0] != at:
            out.append("")
        at = row[0]
        out.append(row[2])
    return "\n".join(out)


def referenced_tables(chunks: DataFrame) -> DataFrame:
    """Tables that retrieved chunks refer to."""
    return chunks.select(F.explode("refs").alias("ref")).where(F.col("ref").startswith("table:")).select(table_of(F.col("ref")).alias("table_id")).distinct()


def check_inputs(question: str | None, n_tables: int) -> None:
    """At least one table and a question that isn't blank."""
    if not n_tables:
        raise GenerationError("the schema has no tables", "NO_TABLES")
    if not (question or "").strip():
        raise GenerationError("the question is blank", "NO_QUESTION")


def _words(text: str) -> set[str]:
    """Lower-case words of a text; of a name with underscores also its parts, each with and without a last s."""
    found = re.findall(r"[^\W_]+(?:_[^\W_]+)*", text.lower())
    parts = {p for w in found for p in (w, *w.split("_"))}
    return parts | {p[:-1] for p in parts if len(p) > 3 and p.endswith("s")}


def ambiguity_notes(question: str, tables: Iterable[str], columns: Iterable[str] = ()) -> list[str]:
    """Notes on a question that doesn't fit the schema (P3), by the tables that it names.

    A question that names none of several tables is told which there are; with a single table the model is told that
    nothing else can be combined with it; an identifier with underscores or in quotes that is neither table nor column is pointed out.
    """
    known = sorted({t.lower() for t in tables})
    said, fields = _words(question), {c.lower() for c in columns}
    out = []
    if len(known) == 1:
        out.append(f"{known[0]} is the only table: combine it with no other.")
    elif known and not any(_words(t) & said for t in known):
        out.append(f"The question names none of the tables {', '.join(known)}: choose by their columns.")
    quoted = re.findall(r"[\"`]([^\W\d]\w*)[\"`]", question) + re.findall(r"\b[^\W\d_]+(?:_[^\W_]+)+\b", question)
    out += [f"{n} is no table here; there are {', '.join(known)}." for n in dict.fromkeys(q.lower() for q in quoted) if n not in known and n not in fields]
    return out


def build_prompt(question: str, ddl: str, dialect: Dialect, notes: Iterable[str] = (), tenants: str | None = None, parameters: bool = False) -> str:
    """What the model is asked."""
    parts = [f"Write one read-only query in {dialect.label}. {dialect.advice}", "Rules: a single SELECT, or WITH and SELECT; no comments; only the tables and columns below; answer with one ```sql block.", f"Schema:\n{ddl}"]
    if tenants:
        parts.append(tenants)
    parts += [f"Note: {n}" for n in notes]
    if parameters:
        parts.append("Add a second block ```sql-unbound with :name in place of each value, and a ```json block {\"parameters\": [{\"name\", \"type\", \"cardinality\", \"value\"}]} that lists them; types are string, number, boolean, date, datetime; cardinality is one or many.")
    parts.append(f"Question: {question.strip()}")
    return "\n\n".join(parts)
