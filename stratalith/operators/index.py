"""Incremental vector index over chunks and search in it."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.errors import ParameterError, SchemaError
from stratalith.functions.text import content_hash
from stratalith.functions.vectors import cosine, hashed_embedding

MAX_K = 25
DEFAULT_K = 8
SCHEMA = "schema_id string, id string, type string, text string, refs array<string>, sensitive boolean, hash string, embedder string, embedding array<float>"
Embedder = Callable[[DataFrame], DataFrame]


def hashed_embedder(dimensions: int = 64) -> Embedder:
    """Deterministic embedder without a model: hashed bag of words, all in the JVM."""
    return lambda chunks: chunks.withColumn("embedding", hashed_embedding(F.col("text"), dimensions))


def batch_embedder(embed: Callable[[list[str]], list[list[float]]], batch: int = 64) -> Embedder:
    """Embedder from a function over texts, called in the workers on Arrow batches cut to ``batch`` texts."""
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out: list[list[float]] = []
        for lo in range(0, len(texts), batch):
            out += embed(texts.iloc[lo : lo + batch].tolist())
        return pd.Series(out)

    return lambda chunks: chunks.withColumn("embedding", run("text"))


def _single(chunks: DataFrame) -> DataFrame:
    """One row an id of a schema: of several the one with the greatest text, then type, whatever order they come in."""
    others = [c for c in chunks.columns if c not in ("schema_id", "id")]
    order = F.struct("text", "type", F.coalesce("sensitive", F.lit(False)), F.array_join("refs", "\u0000"))
    return chunks.groupBy("schema_id", "id").agg(F.max_by(F.struct(*others), order).alias("_row")).select("schema_id", "id", *[F.col(f"_row.{c}") for c in others])


def compare(chunks: DataFrame, index: DataFrame, embedder_id: str) -> DataFrame:
    """(schema_id, id, state) with state reuse, new, changed or orphan.

    Ids are compared within their schema, so indexing one schema leaves others alone; an entry of another
    embedder or without a vector counts as changed. Several chunks of one id count as one, that with the greatest text.
    """
    now = chunks.groupBy("schema_id", "id").agg(content_hash(F.max("text")).alias("hash"))
    schemas = now.select("schema_id").distinct()
    then = index.join(schemas, "schema_id", "left_semi").select("schema_id", "id", F.col("hash").alias("old"), (F.col("embedder") != embedder_id).alias("foreign"), F.col("embedding").isNull().alias("bare"))
    state = (
        F.when(F.col("hash").isNull(), "orphan").when(F.col("old").isNull(), "new")
        .when((F.col("hash") == F.col("old")) & ~F.col("foreign") & ~F.col("bare"), "reuse").otherwise("changed")
    )
    return now.join(then, ["schema_id", "id"], "full").select("schema_id", "id", state.alias("state"))


def reindex(chunks: DataFrame, index: DataFrame, embed: Embedder, embedder_id: str) -> DataFrame:
    """The whole new index: unchanged entries kept, new and changed ones embedded, orphans gone, other schemas untouched."""
    states = compare(chunks, index, embedder_id)
    fresh = _single(chunks).join(states.where("state IN ('new', 'changed')"), ["schema_id", "id"], "left_semi")
    entries = embed(fresh).select("schema_id", "id", "type", "text", "refs", "sensitive", content_hash(F.col("text")).alias("hash"), F.lit(embedder_id).alias("embedder"), "embedding")
    kept = index.join(states.where("state IN ('new', 'changed', 'orphan')"), ["schema_id", "id"], "left_anti")
    return kept.select(*entries.columns).unionByName(entries)


def stale(chunks: DataFrame, index: DataFrame, embedder_id: str) -> DataFrame:
    """One row (stale, n_reuse, n_new, n_changed, n_orphan)."""
    counts = compare(chunks, index, embedder_id).agg(*[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("reuse", "new", "changed", "orphan")])
    return counts.select((F.col("n_new") + F.col("n_changed") + F.col("n_orphan") > 0).alias("stale"), "*")


def refresh(store: VectorStore, chunks: DataFrame, embed: Embedder, embedder_id: str, progress: Callable[[str, dict], None] | None = None) -> dict:
    """Bring a stored index up to date if it is stale, telling ``progress`` of each step (P29, T2). Returns the counts."""
    told = progress or (lambda event, counts: None)
    counts = stale(chunks, store.read(), embedder_id).first().asDict()
    told("index_started", counts)
    if counts["stale"]:
        store.write(reindex(chunks, store.read(), embed, embedder_id))
    told("index_finished", counts)
    return counts


class VectorStore:
    """Index in a Parquet folder, replaced as a whole version at a time.

    A version is written beside the old ones; the current one is the last that is complete (``_SUCCESS``), so a reader never
    meets half an index. Every change writes a whole version: changes are meant to come in sets, as :func:`refresh` makes them.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def version(self) -> int:
        """Number of the current version, 0 for none."""
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return 0
        done = [int(s.getPath().getName()[1:]) for s in fs.listStatus(path(self.path)) if s.getPath().getName()[:1] == "v" and fs.exists(path(f"{self.path}/{s.getPath().getName()}/_SUCCESS"))]
        return max(done, default=0)

    def read(self) -> DataFrame:
        """Current entries."""
        now = self.version()
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/v{now}") if now else self.spark.createDataFrame([], SCHEMA)

    def write(self, entries: DataFrame) -> int:
        """Next version; earlier ones stay until dropped."""
        number = self.version() + 1
        entries.write.mode("overwrite").parquet(f"{self.path}/v{number}")
        return number

    def upsert(self, entries: DataFrame) -> int:
        """Entries by (schema_id, id), the given ones winning."""
        old = self.read()
        return self.write(old.join(entries.select("schema_id", "id"), ["schema_id", "id"], "left_anti").unionByName(entries.select(*old.columns)))

    def delete(self, ids: DataFrame) -> int:
        """Without the given (schema_id, id)."""
        return self.write(self.read().join(ids.select("schema_id", "id"), ["schema_id", "id"], "left_anti"))

    def count(self, **where) -> int:
        """Number of entries that the filter leaves."""
        return self.read().where(entry_filter(**where)).count()

    def hashes(self, prefix: str = "") -> DataFrame:
        """(schema_id, id, hash) of ids with the prefix: the lock of an index."""
        return self.read().where(F.col("id").startswith(prefix)).select("schema_id", "id", "hash").orderBy("schema_id", "id")


def entry_filter(schema_id: str | None = None, types: list[str] | None = None, refs: list[str] | None = None) -> Column:
    """Schema, any of the types, any of the references; what isn't given doesn't filter."""
    out = F.lit(True)
    if schema_id is not None:
        out = out & (F.col("schema_id") == schema_id)
    if types:
        out = out & F.col("type").isin(types)
    if refs:
        out = out & F.arrays_overlap("refs", F.array(*map(F.lit, refs)))
    return out


def search(index: DataFrame, query: Column, k: int = DEFAULT_K, key: str = "id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """The k entries most similar to one vector, best first, ties by key (O1, O2).

    Entries of zero length or another dimension are passed over (F13); a zero query finds nothing. The filter
    is applied before scoring; only the best k rows leave each task.
    """
    rows = index if where is None else index.where(where)
    same = F.size(vector) == F.size(query)
    scored = rows.withColumn("score", F.when(same, cosine(F.col(vector), query))).where("score IS NOT NULL")
    return scored.orderBy(F.desc("score"), key).limit(max(0, k))


def check_k(k: int) -> int:
    """k within 1 and 25."""
    if not isinstance(k, int) or isinstance(k, bool) or not 1 <= k <= MAX_K:
        raise ParameterError(f"k is from 1 to {MAX_K}", "INVALID_K")
    return k


def retriever(index: DataFrame, dimensions: int = 64) -> Callable[..., DataFrame]:
    """Function of a question that searches the index with the hashed embedder."""
    spark = index.sparkSession

    def find(question: str, k: int = DEFAULT_K, **where) -> DataFrame:
        vector = spark.createDataFrame([(question,)], "q string").select(hashed_embedding(F.col("q"), dimensions)).first()[0]
        return search(index, F.array(*[F.lit(float(x)) for x in vector]), check_k(k), where=entry_filter(**where))

    return find


# Fixed value: the first bytes of the interchange format.
MAGIC = b"ARAG"
_HEAD = struct.Struct("<4sIII")


def write_vector_file(entries: DataFrame, base: str) -> None:
    """Interchange file of an index: header, dimensions, count and little-endian floats, payload beside it (S20, X-25).

    For exchange with single-machine tools: the whole index goes through the driver.
    """
    rows = entries.orderBy("id").collect()
    dims = len(rows[0]["embedding"]) if rows else 0
    if any(len(r["embedding"]) != dims for r in rows):
        raise SchemaError("vectors differ in length", "DIMENSION")
    data = np.array([r["embedding"] for r in rows], "<f4")
    Path(f"{base}.bin").write_bytes(_HEAD.pack(MAGIC, 1, dims, len(rows)) + data.tobytes())
    Path(f"{base}.json").write_text(json.dumps([{k: r[k] for k in ("id", "type", "text", "schema_id", "refs", "sensitive", "hash")} for r in rows], ensure_ascii=False))


def read_vector_file(spark: SparkSession, base: str) -> DataFrame:
    """Entries of an interchange file; a wrong header or length is an error."""
    raw = Path(f"{base}.bin").read_bytes()
    if len(raw) < _HEAD.size:
        raise SchemaError("not a vector file", "VECTOR_FILE")
    magic, version, dims, count = _HEAD.unpack_from(raw)
    if magic != MAGIC or version != 1 or len(raw) != _HEAD.size + 4 * dims * count:
        raise SchemaError("not a vector file", "VECTOR_FILE")
    vectors = np.frombuffer(raw, "<f4", offset=_HEAD.size).reshape(count, dims)
    payload = json.loads(Path(f"{base}.json").read_text())
    rows = [(p["schema_id"], p["id"], p["type"], p["text"], p["refs"], p["sensitive"], p["hash"], None, [float(x) for x in v]) for p, v in zip(payload, vectors)]
    return spark.createDataFrame(rows, SCHEMA)
