"""Streaming forms (T1 to T3): windowed counts, incremental index, bounded history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratalith.operators.index import Embedder, VectorStore, reindex


def windowed_events(events: DataFrame, time: str = "ts", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and summed value by window and type; on a stream, rows later than the watermark are left out, on a batch all count."""
    rows = events.withColumn("_at", F.col(time).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("_at", late)
    grouped = rows.groupBy(F.window("_at", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def index_stream(chunks: DataFrame, store: VectorStore, embed: Embedder, embedder_id: str, checkpoint: str) -> StreamingQuery:
    """Keep an index up to date with a stream of whole chunk sets, one batch a schema version.

    Each batch is compared with the stored index by content hash; a batch that is run again after a failure changes nothing.
    """

    def step(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.write(reindex(batch, store.read(), embed, embedder_id))

    return chunks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a table."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
