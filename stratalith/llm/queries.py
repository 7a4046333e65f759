"""Queries of problems 1, 4, 6, 7 and 8, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalith.llm.bpe import decode_column, encode_column
from stratalith.llm.mixture import mixture, mixture_report
from stratalith.llm.split import split_chunks
from stratalith.llm.subject import assign_areas, train
from stratalith.llm.vptree import nearest
from stratalith.sources.tables import table


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of every chunk text."""
    return split_chunks(table(spark, folder, "chunk_texts"), table(spark, folder, "chunk_limits"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that had to be cut."""
    return p1_pieces(spark, folder).where("piece_no = 1").select("id").distinct()


def p1_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk text put together again from its pieces without what they repeat, and whether all of them obey limit and order."""
    limits = table(spark, folder, "chunk_limits").select(F.lower(F.trim("type")).alias("kind"), "max_chars", "overlap_chars")
    kinds = table(spark, folder, "chunk_texts").groupBy("id").agg(F.max_by(F.lower(F.trim("type")), F.struct("indexed_at", "type", "text")).alias("kind"))
    known = kinds.join(F.broadcast(limits), "kind", "left").join(F.broadcast(limits.where("kind = '*'").toDF("any", "any_max", "any_overlap")), F.lit(True))
    known = known.select("id", F.coalesce("max_chars", "any_max").alias("most"), F.coalesce("overlap_chars", "any_overlap").alias("overlap"))
    order = Window.partitionBy("id").orderBy("piece_no")
    done = F.coalesce(F.lag("end_char").over(order), F.lit(0))
    pieces = p1_pieces(spark, folder).join(known, "id").withColumn("done", done)
    repeats = F.col("done") - F.col("start_char")
    sound = (F.length("piece") <= F.col("most")) & (F.length("piece") == F.col("end_char") - F.col("start_char")) & (F.col("end_char") > F.col("done"))
    sound &= repeats.between(F.when(F.col("piece_no") == 0, 0).otherwise(F.col("overlap") - F.floor(F.col("overlap") / 4)), F.col("overlap"))
    parts = F.array_sort(F.collect_list(F.struct("piece_no", F.expr("substring(piece, cast(done - start_char + 1 as int))").alias("part"))))
    whole = pieces.groupBy("id").agg(F.array_join(F.transform(parts, lambda x: x["part"]), "").alias("text"), F.every(sound & (F.col("piece_no") < F.col("n_pieces"))).alias("sound"), (F.count(F.lit(1)) == F.max("n_pieces")).alias("complete"))
    return whole.select("id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"), "sound", "complete")


def _near(spark: SparkSession, folder: str) -> DataFrame:
    near = nearest(table(spark, folder, "chunk_vectors"), "schema_id", "vec_id", "embedding")
    return near.select("schema_id", "vec_id", F.posexplode("near").alias("place", "n")).select("schema_id", "vec_id", (F.col("place") + 1).alias("rank"), F.col("n.id").alias("neighbour_id"), (-F.col("n.neg")).alias("similarity"))


def p4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 most similar other vectors of the same schema for every usable vector."""
    return _near(spark, folder).withColumn("similarity", F.round("similarity", 6))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs with a cosine of at least 0.85 of which one is among the other's 5 most similar."""
    near = _near(spark, folder).where("similarity >= 0.85")
    return near.select(F.least("vec_id", "neighbour_id").alias("vec_id_a"), F.greatest("vec_id", "neighbour_id").alias("vec_id_b")).distinct()


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return encode_column(table(spark, folder, "documents"), "text", ["doc_id"])


def p6_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's token ids as text again, by length and digest."""
    return decode_column(p6_ids(spark, folder), "ids", ["doc_id"]).select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture: one row per emitted copy."""
    return mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached share of each source."""
    return mixture_report(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p7_caps(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each source of the targets keeps its cap, and has its share unless it lacks documents or is at its cap.

    A source's share may differ from the planned one by four standard deviations of the draws, taken as its documents were
    all as long as the mean, times three for their spread.
    """
    rows = p7_shares(spark, folder).where("source IS NOT NULL")
    planned = F.col("rate") * F.col("source_tokens")
    spread = F.lit(12.0) * F.sqrt(F.col("n_documents")) * F.try_divide("source_tokens", "n_documents") / 2
    return rows.select(
        "source", F.round("target_share", 9).alias("target_share"), "max_repeats", (F.col("most_copies") <= F.col("max_repeats")).alias("keeps_cap"),
        (F.coalesce(F.abs(F.col("mixture_tokens") - planned) <= spread, F.col("mixture_tokens") == 0)).alias("as_planned"),
        ((F.col("source_tokens") == 0) | (F.col("rate") >= F.col("max_repeats")) | (planned >= F.col("target_share") * F.sum("source_tokens").over(Window.partitionBy(F.lit(1))) * 0.999)).alias("has_share"),
    )


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Areas of every document."""
    documents = table(spark, folder, "documents")
    return assign_areas(documents, train(documents, table(spark, folder, "doc_labels"), table(spark, folder, "subject_areas")))


def p8_makeup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and share of documents by area; areas without documents count 0."""
    found = p8_found(spark, folder).distinct().groupBy("area").agg(F.count(F.lit(1)).alias("n_documents"))
    total = table(spark, folder, "documents").agg(F.count_distinct("doc_id").alias("n"))
    listed = table(spark, folder, "subject_areas").select("area").distinct()
    joined = listed.join(found, "area", "left").join(F.broadcast(total), F.lit(True))
    return joined.select("area", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.round(F.try_divide(F.coalesce("n_documents", F.lit(0)), "n"), 6).alias("share"))


def queries() -> dict:
    """By name."""
    return {f.__name__: f for f in (p1_found, p1_pieces, p1_rebuilt, p4_found, p4_neighbours, p6_ids, p6_decoded, p7_mixture, p7_shares, p7_caps, p8_found, p8_makeup)}


_NEAR = """
            WITH usable AS (
              SELECT DISTINCT ON (schema_id, vec_id) schema_id, vec_id, embedding::DOUBLE[64] AS e FROM chunk_vectors
              WHERE schema_id IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
            pairs AS (
              SELECT a.schema_id, a.vec_id, b.vec_id AS neighbour_id, round(array_cosine_similarity(a.e, b.e), 12) AS similarity
              FROM usable a JOIN usable b ON a.schema_id = b.schema_id AND a.vec_id <> b.vec_id),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY schema_id, vec_id ORDER BY similarity DESC, neighbour_id) AS rank FROM pairs QUALIFY rank <= 5) """


def oracle_sql() -> dict[str, str]:
    """By name."""
    return {
        "p1_found": r"""
            WITH kinds AS (SELECT *, lower(trim(type)) AS kind FROM chunk_limits),
            texts AS (SELECT id, lower(trim(type)) AS kind, length(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) AS n FROM chunk_texts WHERE text IS NOT NULL)
            SELECT DISTINCT t.id FROM texts t LEFT JOIN kinds k ON k.kind = t.kind
            WHERE t.n > coalesce(k.max_chars, (SELECT max_chars FROM kinds WHERE kind = '*'))""",
        "p1_rebuilt": r"""
            WITH trimmed AS (SELECT DISTINCT id, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS body FROM chunk_texts WHERE text IS NOT NULL)
            SELECT id, length(body)::INT AS n_chars, md5(body) AS digest, true AS sound, true AS complete FROM trimmed WHERE body <> ''""",
        "p4_neighbours": _NEAR + "SELECT schema_id, vec_id, rank::INT AS rank, neighbour_id, round(similarity, 6) AS similarity FROM ranked",
        "p6_decoded": "SELECT doc_id, length(coalesce(text, ''))::INT AS n_chars, md5(coalesce(text, '')) AS digest FROM documents",
        "p7_caps": "SELECT lower(trim(source)) AS source, round(sum(target_share), 9) AS target_share, min(max_repeats)::INT AS max_repeats, true AS keeps_cap, true AS as_planned, true AS has_share FROM mix_targets GROUP BY 1",
        "p4_found": _NEAR + "SELECT DISTINCT least(vec_id, neighbour_id) AS vec_id_a, greatest(vec_id, neighbour_id) AS vec_id_b FROM ranked WHERE similarity >= 0.85",
    }
