"""Registered queries over whole tables, against SQL of their own or counted by hand."""

import datetime as dt
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from conftest import SMALL
from stratalith.functions.text import bullets
from stratalith.operators.chunks import packed_paragraphs
from stratalith.queries.governed import catalog_merge_marks, sensitive_refs
from stratalith.queries.retrieval import token_hashes

SNAPSHOTS = "schema_id string, snapshot_no int, id string, name string, sensitive boolean, delivered_at timestamp"


def snapshots(spark, folder, rows):
    """Column snapshots of (schema_id, snapshot_no, id, name, sensitive, day of delivery)."""
    days = [(*r[:5], dt.datetime(2024, 1, 1) + dt.timedelta(r[5])) for r in rows]
    spark.createDataFrame(days, SNAPSHOTS).write.parquet(f"{folder}/column_snapshots.parquet")
    return str(folder)


def in_duck(sql):
    return Counter(duckdb.sql(sql.replace("column_snapshots", f"'{SMALL}/column_snapshots.parquet'").replace("chunk_texts", f"'{SMALL}/chunk_texts.parquet'")).fetchall())


def test_marks_of_every_schema_and_of_the_last_delivered_snapshots(spark, tmp_path):
    rows = [
        ("a", 1, "x", "x", True, 0), ("a", 4, "x", "x", False, 3), ("a", 4, "y", "y", True, 3), ("a", 1, "gone", "gone", True, 0),
        ("b", 2, "x", "x", False, 1), ("b", 3, "x", "x", True, 2), ("b", 2, "x", "x", True, 5), ("c", 1, "x", "x", False, 0), (None, 9, "x", "x", True, 0),
    ]
    found = catalog_merge_marks(spark, snapshots(spark, tmp_path, rows))
    assert sorted(map(tuple, found.collect())) == [(False, 2, 2), (True, 2, 1)]


def test_marks_equal_sql_over_the_whole_table(spark):
    wanted = in_duck("""WITH last AS (SELECT schema_id, snapshot_no, id, sensitive FROM column_snapshots WHERE schema_id IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY schema_id, snapshot_no, id ORDER BY delivered_at DESC, sensitive NULLS FIRST) = 1),
        placed AS (SELECT *, dense_rank() OVER (PARTITION BY schema_id ORDER BY snapshot_no DESC) AS back FROM last)
        SELECT o.sensitive IS NULL AS is_new, count(*), count(*) FILTER (coalesce(o.sensitive, c.sensitive, false))
        FROM (FROM placed WHERE back = 1) c LEFT JOIN (FROM placed WHERE back = 2) o ON o.id = c.id AND o.schema_id = c.schema_id GROUP BY 1""")
    assert Counter(map(tuple, catalog_merge_marks(spark, SMALL).collect())) == wanted


def fnv(token):
    out = 2166136261
    for byte in token.encode():
        out = (out ^ byte) * 16777619 & 0xFFFFFFFF
    return out


def test_hashes_of_every_name(spark, tmp_path):
    names = ("order_id", "Order Id", "net-price", "Größe", "a a", "日本", None)
    found = token_hashes(spark, snapshots(spark, tmp_path, [("a", 1, f"{i}", n, None, 0) for i, n in enumerate(names)]))
    wanted = [("order_id", "order_id"), ("Order Id", "order"), ("Order Id", "id"), ("net-price", "net"), ("net-price", "price"), ("Größe", "gr"), ("Größe", "e"), ("a a", "a")]
    assert Counter(map(tuple, found.collect())) == Counter([(n, fnv(t)) for n, t in wanted] + [("日本", None)])
    assert {(r["name"],) for r in token_hashes(spark, SMALL).collect()} == in_duck("SELECT DISTINCT name FROM column_snapshots WHERE name IS NOT NULL").keys()


def test_a_mark_taken_back_is_no_mark(spark, tmp_path):
    rows = [
        ("a", 1, "x", "pay", True, 0), ("a", 2, "x", "pay", False, 1), ("b", 1, "x", "pay", True, 0), ("b", 1, "x", "pay", False, 5), ("c", 2, "x", "pay", True, 0), ("c", 1, "x", "pay", False, 9),
        ("d", 1, "x", "pay", True, 0), ("d", 2, "x", "pay", None, 1), ("e", 1, "x", "wage", True, 0), ("e", 2, "x", "pay", True, 1), ("f", 1, "x", "pay", False, 0), ("f", 1, "y", "pay", True, 0),
    ]
    folder = snapshots(spark, tmp_path, rows)
    texts = [(f"{s}{w}", s, f"about {w}.") for s in "abcdef" for w in ("pay", "wage")]
    spark.createDataFrame(texts, "id string, schema_id string, text string").write.parquet(f"{folder}/chunk_texts.parquet")
    assert sorted(map(tuple, sensitive_refs(spark, folder).collect())) == [("c", 1), ("e", 1), ("f", 1)]


def test_sensitive_mentions_equal_sql_with_the_last_row(spark):
    wanted = in_duck("""WITH last AS (SELECT schema_id, name, sensitive FROM column_snapshots WHERE schema_id IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY schema_id, id ORDER BY snapshot_no DESC, delivered_at DESC, sensitive DESC NULLS LAST) = 1),
        names AS (SELECT schema_id, list(DISTINCT name) AS names FROM last WHERE sensitive AND name IS NOT NULL GROUP BY 1),
        texts AS (SELECT DISTINCT id, schema_id, text FROM chunk_texts WHERE schema_id IS NOT NULL AND text IS NOT NULL)
        SELECT t.schema_id, count(*) FROM texts t JOIN names n USING (schema_id) WHERE list_has_any(regexp_extract_all(t.text, '[A-Za-z0-9_]+'), n.names) GROUP BY 1""")
    assert Counter(map(tuple, sensitive_refs(spark, SMALL).collect())) == wanted


def test_giant_texts_have_no_last_paragraph_or_character(spark):
    """A fold over a million paragraphs takes over a minute here, so of it only the expression is looked at."""
    row = spark.range(1).select(F.concat(F.lit("- "), F.repeat(F.lit("b"), 1_000_001), F.lit("c")).alias("b"), F.concat(F.repeat(F.lit("a\n\n"), 900), F.lit("end")).alias("t"))
    assert row.select(F.length(bullets(F.col("b"))[0])).first()[0] == 1_000_002
    assert "1000000" not in str(packed_paragraphs(F.col("t"))) and row.select(F.length(F.array_join(packed_paragraphs(F.col("t")), "\n\n"))).first()[0] == 2703
