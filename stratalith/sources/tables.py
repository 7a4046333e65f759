"""Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STAR_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")
DOMAIN_TABLES = ("schema_registry", "column_snapshots", "artifacts", "catalog_lines", "chunk_texts", "chunk_vectors", "chunk_limits", "type_names", "mix_targets", "subject_areas", "doc_labels")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of the folder, lazily."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register_views(spark: SparkSession, folder: str, names: tuple[str, ...] = STAR_TABLES) -> None:
    """Temporary views over the folder's tables."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)
