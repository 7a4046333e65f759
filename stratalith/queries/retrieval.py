"""Queries of chunking, indexing and vector search, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalith.functions.text import bullets, candidates, column_of, comma_list, content_hash, dash_slug, fenced_block, fnv1a, is_date, plain_sql, table_of, underscore_slug
from stratalith.functions.types import shorten_type, shorten_type_sql
from stratalith.functions.vectors import cosine, norm, token_buckets, tokens
from stratalith.operators.chunks import build_chunks, chunk_stats, packed_paragraphs
from stratalith.operators.index import SCHEMA, compare, entry_filter, hashed_embedder, reindex, search, stale
from stratalith.plans.prompt import referenced_tables
from stratalith.queries.star import star_artifact
from stratalith.sources.artifact import frames
from stratalith.sources.tables import table


def _chunks(spark: SparkSession) -> DataFrame:
    artifact = star_artifact()
    found = frames(spark, artifact)
    concepts = spark.createDataFrame([("star", c["id"], c["label"], c["synonyms"], c["links"], c["description"]) for c in artifact.concepts], "schema_id string, id string, label string, synonyms array<string>, links array<string>, description string")
    policy = spark.createDataFrame([("star", "Scope rules", "Orders follow their customer.")], "schema_id string, section string, body string")
    return build_chunks(found["tables"], found["columns"], found["relationships"], concepts, policy, relationships=True)


def chunk_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and types of all chunks of the star artifact."""
    return _chunks(spark).select("id", "type", "sensitive")


def chunk_type_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks by type."""
    return chunk_stats(_chunks(spark))


def chunk_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Every document packed into parts of whole paragraphs."""
    docs = table(spark, folder, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.posexplode(packed_paragraphs(F.col("text"))).alias("part_no", "part")).select("doc_id", "part_no", F.length("part").alias("n_chars"), F.md5("part").alias("digest"))


def chunk_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Content hash of every document."""
    return table(spark, folder, "documents").select("doc_id", content_hash(F.col("text")).alias("hash"))


def chunk_text_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk texts by tidied type: rows, distinct ids, sensitive ones."""
    rows = table(spark, folder, "chunk_texts").withColumn("kind", F.lower(F.trim("type")))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids"), F.count_if(F.coalesce("sensitive", F.lit(False))).alias("n_sensitive"))


def _old_index(spark: SparkSession, folder: str) -> DataFrame:
    """An index of chunk texts as it might have been: every fifth changed, every seventh missing, some that are gone."""
    rows = table(spark, folder, "chunk_texts").where("id IS NOT NULL AND text IS NOT NULL AND schema_id IS NOT NULL").dropDuplicates(["schema_id", "id"])
    number = F.conv(F.substring(F.md5("id"), 1, 4), 16, 10).cast("int")
    was = rows.withColumn("_n", number).where("_n % 7 <> 0").withColumn("text", F.when(F.col("_n") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    was = was.withColumn("id", F.when(F.col("_n") % 11 == 0, F.concat("id", F.lit("#gone"))).otherwise(F.col("id")))
    return was.select("schema_id", "id", "type", "text", "refs", "sensitive", content_hash(F.col("text")).alias("hash"), F.lit("hashed").alias("embedder"), F.array(F.lit(1.0).cast("float")).alias("embedding"))


def _now(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunk_texts").where("id IS NOT NULL AND text IS NOT NULL AND schema_id IS NOT NULL")


def index_diff(spark: SparkSession, folder: str) -> DataFrame:
    """State of every chunk against an older index."""
    return compare(_now(spark, folder), _old_index(spark, folder), "hashed")


def index_status(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the index is stale, and why."""
    return stale(_now(spark, folder), _old_index(spark, folder), "hashed")


def index_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """The index after the update, by type."""
    new = reindex(_now(spark, folder), _old_index(spark, folder), hashed_embedder(), "hashed")
    return new.groupBy("schema_id").agg(F.count(F.lit(1)).alias("n_entries"), F.count_if(F.size("embedding") == 64).alias("n_embedded"))


def mock_embed_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of all documents by bucket of the hashed embedder."""
    words = table(spark, folder, "documents").select(F.explode(tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return words.groupBy(token_buckets(F.col("token"), 64)[0].alias("bucket")).agg(F.sum("n").alias("n_tokens"))


def token_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """FNV-1a of every distinct token of every distinct column name, as the embedder cuts them; null for a name without tokens."""
    names = table(spark, folder, "column_snapshots").where("name IS NOT NULL").select("name").distinct()
    return names.select("name", F.explode_outer(F.array_distinct(tokens(F.col("name")))).alias("token")).select("name", fnv1a(F.col("token")).alias("hash"))


def _query_vector(spark: SparkSession, folder: str):
    first = table(spark, folder, "embeddings").orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    return F.broadcast(first)


def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Ten vectors most similar to the first."""
    rows = table(spark, folder, "embeddings").join(_query_vector(spark, folder), F.lit(True))
    return search(rows, F.col("q"), 10, key="vec_id").select("vec_id", F.round("score", 6).alias("score"))


def vector_topk_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """The same among one label."""
    rows = table(spark, folder, "embeddings").join(_query_vector(spark, folder), F.lit(True))
    return search(rows, F.col("q"), 10, key="vec_id", where=F.col("label") == 3).select("vec_id", F.round("score", 6).alias("score"))


def vector_topk_batch(spark: SparkSession, folder: str) -> DataFrame:
    """The three most similar vectors of the same label for every query whose id divides by 20."""
    rows = table(spark, folder, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")
    scored = rows.join(asked, "label").where("vec_id <> query_id").select("query_id", "vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("place", place - 1).where("place < 3").select("query_id", "place", "vec_id", "score")


def vector_norms(spark: SparkSession, folder: str) -> DataFrame:
    """Length of every vector."""
    return table(spark, folder, "embeddings").select("vec_id", F.round(norm(F.col("embedding")), 6).alias("length"))


_REFS = (
    "table:public.auction_log_195", "table:public.batch_81", "table:public.courier_354", "table:public.auction_alert_324", "table:public.greenhouse_quota_223", "table:public.greenhouse_quota_223#is_void",
    "table:public.warranty_285#height_mm",
)


def chunk_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of one schema and two types that refer to any of the listed tables and columns."""
    wanted = entry_filter("tidewater-main", ["table", "column"], list(_REFS))
    return table(spark, folder, "chunk_texts").where(wanted).select("id", "type").distinct()


def retrieval_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Tables that each type of chunk refers to, counted."""
    rows = table(spark, folder, "chunk_texts").where("refs IS NOT NULL")
    return referenced_tables(rows).agg(F.count(F.lit(1)).alias("n_tables"))


def text_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Slugs, ids and lists of the snapshots' columns."""
    ids = table(spark, folder, "column_snapshots").where("id IS NOT NULL").select("id").distinct()
    return ids.select("id", table_of(F.col("id")).alias("table_id"), column_of(F.col("id")).alias("column_name"), underscore_slug(F.col("id")).alias("slug"), dash_slug(F.col("id")).alias("dashed"))


def type_shortening(spark: SparkSession, folder: str) -> DataFrame:
    """Short form of every distinct type."""
    return table(spark, folder, "column_snapshots").where("type IS NOT NULL").select("type").distinct().select("type", shorten_type(F.col("type")).alias("short"))


_REPLIES = ("```sql\nselect 1\n```", "text\n```json\n{}\n```\n```sql\nselect a\nfrom t\n```", "no block")


def reply_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Statements fenced in replies."""
    rows = spark.createDataFrame(list(enumerate(_REPLIES)), "n int, reply string")
    return rows.select("n", fenced_block(F.col("reply"), "sql").alias("sql"), plain_sql(fenced_block(F.col("reply"), "sql")).alias("plain"))


def list_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Bullets, comma lists and candidates."""
    rows = spark.createDataFrame([("- a\n* b \nx\n-c", " x, ,y,", "one\n---\n\n-----\ntwo\n---\nthree\n---\nfour")], "b string, c string, d string")
    return rows.select(F.array_join(bullets(F.col("b")), "|").alias("bullets"), F.array_join(comma_list(F.col("c")), "|").alias("commas"), F.array_join(candidates(F.col("d")), "|").alias("candidates"))


def date_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Which texts are dates."""
    rows = spark.createDataFrame([("2024-02-29",), ("2024-99-99",), ("2023-02-29",), ("24-01-01",)], "d string")
    return rows.select("d", is_date(F.col("d")).alias("ok"))


_ALL = (
    chunk_ids, chunk_type_stats, chunk_paragraphs, chunk_hashes, chunk_text_stats, index_diff, index_status, index_rebuilt, mock_embed_buckets, token_hashes, vector_topk, vector_topk_filtered,
    vector_topk_batch, vector_norms, chunk_filter, retrieval_tables, text_functions, type_shortening, reply_blocks, list_functions, date_shapes,
)


def queries() -> dict:
    """By name."""
    return {f.__name__: f for f in _ALL}


_COS = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"
_INDEX = """WITH now AS (SELECT DISTINCT schema_id, id, sha256(text) AS hash FROM chunk_texts WHERE id IS NOT NULL AND text IS NOT NULL AND schema_id IS NOT NULL),
    was AS (SELECT schema_id, CASE WHEN n % 11 = 0 THEN id || '#gone' ELSE id END AS id, sha256(CASE WHEN n % 5 = 0 THEN text || '!' ELSE text END) AS hash
            FROM (SELECT DISTINCT schema_id, id, text, ('0x' || md5(id)[1:4])::INT AS n FROM chunk_texts WHERE id IS NOT NULL AND text IS NOT NULL AND schema_id IS NOT NULL) WHERE n % 7 <> 0),
    states AS (SELECT coalesce(n.schema_id, w.schema_id) AS schema_id, coalesce(n.id, w.id) AS id,
               CASE WHEN n.id IS NULL THEN 'orphan' WHEN w.id IS NULL THEN 'new' WHEN n.hash = w.hash THEN 'reuse' ELSE 'changed' END AS state
               FROM now n FULL JOIN was w ON n.schema_id = w.schema_id AND n.id = w.id) """


def oracle_sql() -> dict[str, str]:
    """By name."""
    return {
        "chunk_ids": """WITH c AS (SELECT table_name, column_name FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'part', 'orders', 'lineitem') AND column_name NOT IN ('c_name', 'c_acctbal')),
            t AS (SELECT unnest(['region', 'nation', 'customer', 'part', 'orders', 'lineitem']) AS n),
            links AS (SELECT * FROM (VALUES ('nation', 'n_regionkey', 'region', 'r_regionkey'), ('customer', 'c_nationkey', 'nation', 'n_nationkey'), ('orders', 'o_custkey', 'customer', 'c_custkey'),
              ('lineitem', 'l_orderkey', 'orders', 'o_orderkey'), ('lineitem', 'l_partkey', 'part', 'p_partkey')) l(a, b, c, d))
            SELECT 'chunk:table:public.' || table_name || '#' || column_name AS id, 'column' AS type, false AS sensitive FROM c
            UNION ALL SELECT 'chunk:table:public.' || n, 'table', false FROM t
            UNION ALL SELECT 'chunk:table:public.' || a || '#' || b || '->table:public.' || c || '#' || d, 'relationship', false FROM links
            UNION ALL SELECT * FROM (VALUES ('chunk:table:public.orders#cql', 'cql', false), ('chunk:table:public.orders#biz', 'table', false), ('chunk:table:public.customer#biz', 'table', false),
              ('chunk:table:public.orders#q:1', 'question', false), ('chunk:table:public.orders#q:2', 'question', false), ('chunk:concept:revenue', 'concept', false), ('chunk:tenant-policy#scope-rules', 'tenant-policy', false))""",
        "chunk_type_stats": """SELECT 'column' AS type, count(*) AS n_chunks, 0::BIGINT AS n_sensitive FROM information_schema.columns
            WHERE table_name IN ('region', 'nation', 'customer', 'part', 'orders', 'lineitem') AND column_name NOT IN ('c_name', 'c_acctbal')
            UNION ALL SELECT * FROM (VALUES ('table', 8::BIGINT, 0::BIGINT), ('cql', 1::BIGINT, 0::BIGINT), ('question', 2::BIGINT, 0::BIGINT), ('concept', 1::BIGINT, 0::BIGINT), ('relationship', 5::BIGINT, 0::BIGINT), ('tenant-policy', 1::BIGINT, 0::BIGINT)) t(type, n_chunks, n_sensitive)""",
        "chunk_paragraphs": r"""WITH trimmed AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS body FROM documents WHERE text IS NOT NULL),
            cells AS (SELECT doc_id, body, list_transform(regexp_split_to_array(body, '\n\s*\n'), lambda p: {'done': []::VARCHAR[], 'open': p, 'n': length(p) + 2}) AS c FROM trimmed),
            folded AS (SELECT doc_id, body, list_reduce(c, lambda a, x: CASE WHEN a.n + length(x.open) > 1000 THEN {'done': list_append(a.done, a.open), 'open': x.open, 'n': x.n}
                       ELSE {'done': a.done, 'open': a.open || chr(10) || chr(10) || x.open, 'n': a.n + x.n} END) AS f FROM cells),
            parts AS (SELECT doc_id, CASE WHEN length(body) <= 1000 THEN [body] ELSE list_append(f.done, f.open) END AS p FROM folded),
            rows AS (SELECT doc_id, unnest(p) AS part, unnest(range(len(p)::BIGINT)) AS part_no FROM parts),
            tidy AS (SELECT doc_id, part_no::INT AS part_no, regexp_replace(regexp_replace(part, '^\s+', ''), '\s+$', '') AS part FROM rows)
            SELECT doc_id, part_no, length(part)::INT AS n_chars, md5(part) AS digest FROM tidy""",
        "chunk_hashes": "SELECT doc_id, sha256(text) AS hash FROM documents",
        "chunk_text_stats": "SELECT lower(trim(type)) AS kind, count(*) AS n_rows, count(DISTINCT id) AS n_ids, count(*) FILTER (coalesce(sensitive, false)) AS n_sensitive FROM chunk_texts GROUP BY 1",
        "index_diff": _INDEX + "SELECT * FROM states",
        "index_status": _INDEX + """SELECT count(*) FILTER (state <> 'reuse') > 0 AS stale, count(*) FILTER (state = 'reuse') AS n_reuse, count(*) FILTER (state = 'new') AS n_new,
            count(*) FILTER (state = 'changed') AS n_changed, count(*) FILTER (state = 'orphan') AS n_orphan FROM states""",
        "index_rebuilt": _INDEX + "SELECT schema_id, count(*) AS n_entries, count(*) FILTER (state <> 'reuse') AS n_embedded FROM states WHERE state <> 'orphan' GROUP BY 1",
        "mock_embed_buckets": """WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM documents), d AS (SELECT token, count(*) AS n FROM t GROUP BY 1),
            h AS (SELECT n, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(token, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS hash FROM d)
            SELECT (hash % 64)::INT AS bucket, sum(n)::BIGINT AS n_tokens FROM h GROUP BY 1""",
        "token_hashes": """WITH n AS (SELECT DISTINCT name FROM column_snapshots WHERE name IS NOT NULL), t AS (SELECT name, unnest(list_distinct(regexp_extract_all(lower(name), '[a-z0-9_]+'))) AS token FROM n)
            SELECT name, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(token, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS hash
            FROM n LEFT JOIN t USING (name)""",
        "vector_topk": f"WITH q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) SELECT e.vec_id, {_COS} AS score FROM embeddings e, q ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, 1 LIMIT 10",
        "vector_topk_filtered": f"WITH q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) SELECT e.vec_id, {_COS} AS score FROM embeddings e, q WHERE label = 3 ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, 1 LIMIT 10",
        "vector_topk_batch": f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {_COS} AS score FROM embeddings e JOIN embeddings q ON e.label = q.label AND q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id),
            r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s) SELECT query_id, (n - 1)::INT AS place, vec_id, score FROM r WHERE n <= 3""",
        "vector_norms": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS length FROM embeddings",
        "chunk_filter": f"SELECT DISTINCT id, type FROM chunk_texts WHERE schema_id = 'tidewater-main' AND type IN ('table', 'column') AND list_has_any(refs, {list(_REFS)})",
        "retrieval_tables": "SELECT count(DISTINCT split_part(ref, '#', 1)) AS n_tables FROM (SELECT unnest(refs) AS ref FROM chunk_texts) WHERE ref LIKE 'table:%'",
        "text_functions": """SELECT DISTINCT id, split_part(id, '#', 1) AS table_id, CASE WHEN contains(id, '#') THEN substr(id, instr(id, '#') + 1) ELSE '' END AS column_name,
            regexp_replace(lower(id), '[^a-z0-9]+', '_', 'g') AS slug, regexp_replace(lower(id), '[^a-z0-9]+', '-', 'g') AS dashed FROM column_snapshots WHERE id IS NOT NULL""",
        "type_shortening": f"SELECT DISTINCT type, {shorten_type_sql('type')} AS short FROM column_snapshots WHERE type IS NOT NULL",
        "reply_blocks": "SELECT * FROM (VALUES (0, 'select 1', 'select 1'), (1, 'select a' || chr(10) || 'from t', 'select a from t'), (2, NULL, NULL)) t(n, sql, plain)",
        "list_functions": "SELECT 'a|b' AS bullets, 'x|y' AS commas, 'one|two|three' AS candidates",
        "date_shapes": "SELECT d, regexp_full_match(d, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(d AS DATE) IS NOT NULL AS ok FROM (VALUES ('2024-02-29'), ('2024-99-99'), ('2023-02-29'), ('24-01-01')) t(d)",
    }
