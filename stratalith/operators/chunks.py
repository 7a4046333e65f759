"""Chunks of a described schema, for retrieval (P27, P28, W2, W3, A6, F7, F8, J18, X-12)."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalith.functions.text import column_of, dash_slug, table_of

MAX_CHARS = 1000
BLANK = " \t\n\r\f\v"
_GAP = re.compile(r"\n\s*\n", re.ASCII)
# The kinds of chunk.
KINDS = ("table", "column", "cql", "question", "concept", "relationship", "tenant-policy")


def pack(body: str | None, most: int) -> list[str] | None:
    """Parts of one text, by one pass over its paragraphs."""
    if body is None:
        return None
    text = body.strip(BLANK)
    if len(text) <= most:
        return [text]
    first, *others = _GAP.split(text)
    parts, held, n = [], [first], len(first) + 2
    for paragraph in others:
        if n + len(paragraph) > most:
            parts.append(held)
            held, n = [], 0
        held.append(paragraph)
        n += len(paragraph) + 2
    return ["\n\n".join(h).strip(BLANK) for h in [*parts, held]]


def packed_paragraphs(body: Column, most: int = MAX_CHARS) -> Column:
    """Parts of a text: whole paragraphs packed greedily up to ``most`` characters.

    A text that fits is one part. A longer paragraph stays whole: it is one part by itself. Lengths are
    counted in code points, and each paragraph counts two more for the gap after it. Null stays null; a blank
    text is one empty part. Scale: one Arrow pass, linear in the text (a fold in the JVM copies its parts at every step).
    """

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([pack(t, most) for t in texts.to_pylist()], pa.list_(pa.string()))

    return run(body)


def mentions_any(text: Column, names: Column) -> Column:
    """Whether any of the names occurs as a whole word, case-sensitively (X-12); false for nulls."""
    quoted = lambda n: F.concat(F.lit(r"(^|[^a-zA-Z0-9_])\Q"), n, F.lit(r"\E([^a-zA-Z0-9_]|$)"))
    return F.coalesce(F.exists(names, lambda n: F.regexp_like(text, quoted(n))), F.lit(False))


def _parts(df: DataFrame, body: str, most: int) -> DataFrame:
    """One row a part of ``body`` with its suffix, empty for a single part."""
    parts = packed_paragraphs(F.col(body), most)
    return df.where(F.trim(body) != "").withColumn("_parts", parts).select("*", F.posexplode("_parts").alias("_n", "_part")).withColumn("_suffix", F.when(F.size("_parts") > 1, F.concat(F.lit("#bc:"), F.col("_n") + 1)).otherwise(""))


def _chunk(identifier: Column, kind: str, text: Column, refs: Column, sensitive: Column) -> list[Column]:
    return [F.concat(F.lit("chunk:"), identifier).alias("id"), F.lit(kind).alias("type"), text.alias("text"), F.col("schema_id"), refs.alias("refs"), sensitive.alias("sensitive")]


def _lines(*parts: Column) -> Column:
    return F.trim(F.concat_ws("\n", *parts))


def _listed(label: str, values: Column) -> Column:
    return F.when(F.size(values) > 0, F.concat(F.lit(f"{label}: "), F.array_join(values, ", ")))


def _flags(nullable: str = "nullable", key: str = "primary_key") -> Column:
    return F.concat(F.when(F.col(key), "PK ").otherwise(""), F.when(F.col(nullable), "NULL").otherwise("NOT NULL"))


def build_chunks(
    tables: DataFrame, columns: DataFrame, links: DataFrame, concepts: DataFrame | None = None, policy: DataFrame | None = None,
    include_sensitive: bool = False, most: int = MAX_CHARS, relationships: bool = False,
) -> DataFrame:
    """Chunks (id, type, text, schema_id, refs, sensitive) of the frames that an artifact gives.

    Untracked tables give none. What is sensitive, or mentions a sensitive column of its table, is left out unless
    included; one such question leaves out all questions of the table. ``concepts``: (schema_id, id, label, synonyms,
    links, description); ``policy``: (schema_id, section, body). Ids are unique; sort by id for the stable order.
    """
    keep = F.lit(include_sensitive)
    live = tables.where(F.coalesce("tracked", F.lit(True)))
    name = F.concat_ws(".", "schema", "name")
    secret = columns.where("sensitive").groupBy("table_id").agg(F.collect_set("name").alias("secret_names"))
    live = live.join(secret, "table_id", "left")
    cols = columns.join(live.select("table_id", F.col("schema").alias("t_schema"), F.col("name").alias("t_name"), F.col("sensitive").alias("t_sensitive")), "table_id")
    hidden_columns = columns.where("sensitive").select("schema_id", F.col("column_id").alias("_id")).unionAll(tables.where("sensitive").select("schema_id", F.col("table_id").alias("_id"))).distinct()
    dead_tables = tables.where(~F.coalesce("tracked", F.lit(True))).select("schema_id", F.col("table_id").alias("_id"))

    dead, hidden = dead_tables.select("_id"), hidden_columns.select("_id")
    sound = links.join(dead, table_of(F.col("from_id")) == F.col("_id"), "left_anti").join(dead, table_of(F.col("to_id")) == F.col("_id"), "left_anti")
    shown = sound
    if not include_sensitive:
        shown = sound.join(hidden, F.col("from_id") == F.col("_id"), "left_anti").join(hidden, F.col("to_id") == F.col("_id"), "left_anti")
    link_lines = shown.groupBy("table_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", F.concat(F.lit("- "), "from_id", F.lit(" -> "), "to_id").alias("line")))), lambda x: x["line"]).alias("link_lines"))
    any_link = links.select("table_id").distinct().withColumn("_linked", F.lit(True))
    described = F.when(~F.col("sensitive") & ~F.col("t_sensitive") & F.col("description").isNotNull() & (F.col("description") != ""), F.concat(F.lit(" — "), "description")).otherwise("")
    column_line = F.concat(F.lit("- "), "name", F.lit(" "), "type", F.lit(" ("), _flags(), F.lit(")"), F.when(F.col("sensitive"), " (sensitive)").otherwise(""), described)
    shown_columns = cols if include_sensitive else cols.where("NOT sensitive AND NOT t_sensitive")
    column_lines = shown_columns.groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("position", column_line.alias("line"), "column_id"))).alias("c"))
    whole = live.join(link_lines, "table_id", "left").join(any_link, "table_id", "left").join(column_lines, "table_id", "left")
    open_ = ~F.col("sensitive")
    c = F.coalesce("c", F.array().cast("array<struct<position: int, line: string, column_id: string>>"))
    table_chunks = whole.where(open_ | keep).select(*_chunk(
        F.col("table_id"), "table",
        _lines(F.concat(F.lit("# "), name), F.when(open_ & (F.col("description") != ""), F.col("description")), F.when(open_, _listed("Aliases", F.col("aliases"))),
               F.when(open_ & F.col("primary_entity").isNotNull(), F.concat(F.lit("Primary entity: "), "primary_entity")), F.when(F.col("_linked"), F.lit("Relationships:")),
               F.when(F.size("link_lines") > 0, F.array_join("link_lines", "\n")), F.lit("Columns:"), F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: x["line"]), "\n"))),
        F.concat(F.array("table_id"), F.transform(c, lambda x: x["column_id"])), F.col("sensitive")))

    may = ~F.col("sensitive") | keep
    said = lambda value: F.when(may & F.col(value).isNotNull() & (F.col(value) != ""), F.col(value))
    column_chunks = cols.where(may).select(*_chunk(
        F.col("column_id"), "column",
        _lines(F.concat(F.lit("Column: "), F.concat_ws(".", "t_schema", "t_name", "name"), F.lit(" "), "type", F.lit(" ("), _flags(), F.lit(")"), F.when(F.col("sensitive"), " (sensitive)").otherwise("")),
               F.concat(F.lit("Id: "), "column_id"), said("description"), _listed("Aliases", F.col("aliases")), _listed("Values", F.col("enum")), F.concat(F.lit("Note: "), said("note"))),
        F.array("table_id", "column_id"), F.col("sensitive")))

    also = F.when(F.size("aliases") > 0, F.concat(F.lit(" (also: "), F.array_join("aliases", ", "), F.lit(")"))).otherwise("")
    gated = lambda body: live.withColumn("_hides", F.col("sensitive") | mentions_any(F.col(body), F.col("secret_names"))).where(~F.col("_hides") | keep)
    cql_chunks = _parts(gated("common_query_language"), "common_query_language", most).select(*_chunk(
        F.concat("table_id", F.lit("#cql"), "_suffix"), "cql", F.concat(F.lit("# "), name, also, F.lit(" — common query language\n"), "_part"), F.array("table_id"), F.col("_hides")))
    context_chunks = _parts(gated("business_context"), "business_context", most).select(*_chunk(
        F.concat("table_id", F.lit("#biz"), "_suffix"), "table", F.concat(F.lit("# "), name, F.lit(" — business context\n"), "_part"), F.array("table_id"), F.col("_hides")))
    one_hides = F.exists("questions", lambda q: mentions_any(q, F.col("secret_names")))
    asked = live.where(~(F.col("sensitive") | F.coalesce(one_hides, F.lit(False))) | keep).select("*", F.posexplode("questions").alias("_n", "_q"))
    entity = F.when(F.col("primary_entity").isNotNull(), F.concat(F.lit(" ["), "primary_entity", F.lit("]"))).otherwise("")
    question_chunks = asked.select(*_chunk(
        F.concat("table_id", F.lit("#q:"), F.col("_n") + 1), "question", F.concat(F.lit("# "), name, entity, F.lit(" — example question\n"), F.trim("_q")), F.array("table_id"), F.col("sensitive") | mentions_any(F.col("_q"), F.col("secret_names"))))
    out = table_chunks.unionByName(column_chunks).unionByName(cql_chunks).unionByName(context_chunks).unionByName(question_chunks)

    if relationships:
        ends = tables.select("table_id", name.alias("full"), "sensitive")
        marks = hidden.withColumn("_hit", F.lit(True))
        joined = (
            sound.join(ends.toDF("_ft", "_fn", "_fs"), table_of(F.col("from_id")) == F.col("_ft"), "left").join(ends.toDF("_tt", "_tn", "_ts"), table_of(F.col("to_id")) == F.col("_tt"), "left")
            .join(marks.toDF("_f", "_fh"), F.col("from_id") == F.col("_f"), "left").join(marks.toDF("_t", "_th"), F.col("to_id") == F.col("_t"), "left")
        )
        hides = F.coalesce("_fs", F.lit(False)) | F.coalesce("_ts", F.lit(False)) | F.coalesce("_fh", F.lit(False)) | F.coalesce("_th", F.lit(False))
        text = F.concat(F.lit("Relationship: "), F.coalesce("_fn", table_of(F.col("from_id"))), F.lit("."), column_of(F.col("from_id")), F.lit(" references "), F.coalesce("_tn", table_of(F.col("to_id"))), F.lit("."), column_of(F.col("to_id")))
        out = out.unionByName(joined.where(~hides | keep).join(live.select("table_id"), "table_id", "left_semi").select(*_chunk(
            F.concat("from_id", F.lit("->"), "to_id"), "relationship", text, F.array(table_of(F.col("from_id")), table_of(F.col("to_id")), F.col("from_id"), F.col("to_id")), hides)))
    if concepts is not None:
        secret_of = columns.where("sensitive").groupBy("schema_id").agg(F.collect_set("name").alias("_secret"))
        hidden_of = hidden_columns.groupBy("schema_id").agg(F.collect_set("_id").alias("_hidden"))
        dead_of = dead_tables.groupBy("schema_id").agg(F.collect_set("_id").alias("_dead"))
        known = concepts.join(secret_of, "schema_id", "left").join(hidden_of, "schema_id", "left").join(dead_of, "schema_id", "left")
        none = F.array().cast("array<string>")
        known = known.withColumns({c: F.coalesce(c, none) for c in ("_secret", "_hidden", "_dead")})
        known = known.withColumn("_links", F.filter("links", lambda x: ~F.array_contains("_dead", table_of(x)))).withColumn("_told", mentions_any(F.col("description"), F.col("_secret")))
        known = known.withColumn("_hides", F.arrays_overlap("_links", "_hidden") | F.col("_told"))
        out = out.unionByName(known.where(~F.coalesce("_hides", F.lit(False)) | keep).select(*_chunk(
            F.col("id"), "concept",
            _lines(F.concat(F.lit("# Concept: "), "label"), F.concat(F.lit("Id: "), "id"), _listed("Synonyms", F.col("synonyms")), _listed("Links", F.col("_links")), F.when((~F.col("_told") | keep) & (F.col("description") != ""), F.col("description"))),
            F.concat(F.array("id"), F.col("_links")), F.coalesce("_hides", F.lit(False)))))
    if policy is not None:
        out = out.unionByName(_parts(policy, "body", most).select(*_chunk(
            F.concat(F.lit("tenant-policy#"), F.when(F.col("section") == "", F.lit("body")).otherwise(dash_slug(F.col("section"))), "_suffix"), "tenant-policy",
            F.concat(F.lit("# Tenant policy"), F.when(F.col("section") == "", "").otherwise(F.concat(F.lit(" — "), "section")), F.lit("\n"), "_part"), F.array().cast("array<string>"), F.lit(False))))
    return out


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Chunks and sensitive chunks by type."""
    return chunks.groupBy("type").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if("sensitive").alias("n_sensitive"))
