"""Most similar vectors of every vector (problem 4), by vantage-point trees per shard.

Vectors are taken to unit length, so that cosine order is chord-distance order and the
triangle inequality holds. Each shard has a vantage-point tree; a leaf is visited if its
lower bound times ``factor`` is below the distance of the k-th neighbour found so
far. Factor one restores exact search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.session import cut_lineage

LEAF = 512
SHARD_ROWS = 12_288
SAMPLE_PER_SHARD = 64
MAX_SAMPLE = 100_000
HOST_SHARDS = 8
SALT_ROWS = 131_072
MAX_SHARDS = 100_000
SLACK = 1e-5
DIGITS = 12


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows in double precision at length one."""
    wide = rows.astype(np.float64)
    scale = np.abs(wide).max(axis=1, keepdims=True)
    wide /= scale
    return wide / np.sqrt(np.einsum("ij,ij->i", wide, wide))[:, None]


def chord(cosine: np.ndarray) -> np.ndarray:
    """Distance of unit vectors."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


class Tree:
    """Vantage-point tree over unit vectors; leaves are runs of ``order``."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, depth: int = 64) -> None:
        self.points = points
        self.order = np.arange(len(points))
        self.vantage: list[np.ndarray] = []
        self.path: list[tuple[tuple[int, float, float], ...]] = []
        self.spans: list[tuple[int, int]] = []
        if len(points):
            self._build(0, len(points), leaf, depth, ())
        self.centres = np.array(self.vantage) if self.vantage else np.zeros((0, points.shape[1]))

    def _build(self, lo: int, hi: int, leaf: int, depth: int, path: tuple[tuple[int, float, float], ...]) -> None:
        if hi - lo <= leaf or depth == 0:
            self.spans.append((lo, hi))
            self.path.append(path)
            return
        rows = self.order[lo:hi]
        tried = rows[:: max(1, len(rows) // 5)][:5]
        probe = self.points[rows[:: max(1, len(rows) // 256)]]
        spread = chord(self.points[tried] @ probe.T).std(axis=1)
        centre = self.points[tried[int(np.argmax(spread))]]
        distance = chord(self.points[rows] @ centre)
        rank = np.argsort(distance, kind="stable")
        self.order[lo:hi] = rows[rank]
        distance = distance[rank]
        mid = (hi - lo) // 2
        if distance[0] == distance[-1]:
            self.spans.append((lo, hi))
            self.path.append(path)
            return
        number = len(self.vantage)
        self.vantage.append(centre)
        self._build(lo, lo + mid, leaf, depth - 1, (*path, (number, distance[0], distance[mid - 1])))
        self._build(lo + mid, hi, leaf, depth - 1, (*path, (number, distance[mid], distance[-1])))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Lower bound of each query's distance to any point of each leaf."""
        out = np.zeros((len(queries), len(self.spans)))
        if not len(self.centres):
            return out
        distance = chord(queries @ self.centres.T)
        for leaf, path in enumerate(self.path):
            for number, low, high in path:
                d = distance[:, number]
                np.maximum(out[:, leaf], np.maximum(low - d, d - high), out=out[:, leaf])
        return out

    def route(self, queries: np.ndarray) -> np.ndarray:
        """The leaf that each query falls in: down the tree, by the nearer side."""
        out = np.zeros(len(queries), np.int32)
        best = np.full(len(queries), np.inf)
        bounds = self.bounds(queries)
        for leaf in range(len(self.spans)):
            nearer = bounds[:, leaf] < best
            out[nearer], best[nearer] = leaf, bounds[nearer, leaf]
        return out


def reach(kth: np.ndarray) -> np.ndarray:
    """Distance within which a point could still be among the k nearest."""
    return np.where(np.isneginf(kth), np.inf, chord(np.maximum(kth, -1.0)) + SLACK)


class Found:
    """The k nearest so far of a block of queries, by similarity, then smaller id."""

    def __init__(self, n: int, k: int, sims: np.ndarray | None = None) -> None:
        self.k = k
        self.sims = np.full((n, k), -np.inf) if sims is None else sims
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def kth(self) -> np.ndarray:
        """Similarity that a newcomer has to reach."""
        return self.sims[:, -1]

    def offer(self, rows: np.ndarray, sims: np.ndarray, ids: np.ndarray) -> None:
        """Take newcomers (row of the block, similarity, id)."""
        touched = np.unique(rows)
        if not len(touched):
            return
        all_rows = np.concatenate([np.repeat(touched, self.k), rows])
        all_sims = np.concatenate([self.sims[touched].ravel(), sims])
        all_ids = np.concatenate([self.ids[touched].ravel(), ids])
        order = np.lexsort((all_ids, -all_sims, all_rows))
        all_rows, all_sims, all_ids = all_rows[order], all_sims[order], all_ids[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (all_rows[1:] != all_rows[:-1]) | (all_ids[1:] != all_ids[:-1]) | np.isneginf(all_sims[1:])
        all_rows, all_sims, all_ids = all_rows[fresh], all_sims[fresh], all_ids[fresh]
        starts = np.searchsorted(all_rows, touched)
        place = starts[:, None] + np.arange(self.k)
        ends = np.append(starts[1:], len(all_rows))
        there = place < ends[:, None]
        place = np.minimum(place, len(all_rows) - 1)
        self.sims[touched] = np.where(there, all_sims[place], -np.inf)
        self.ids[touched] = np.where(there, all_ids[place], np.iinfo(np.int64).max)


def search(tree: Tree, narrow: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, found: Found, factor: float) -> int:
    """Bring ``found`` up to date with the tree's points; returns the number of distances computed.

    ``narrow`` are the points in single precision in leaf order: they preselect (with slack);
    every similarity that counts is computed in double precision.
    """
    bounds = tree.bounds(queries)
    thin = queries.astype(np.float32)
    work = 0
    for leaf in np.argsort(bounds.min(axis=0), kind="stable"):
        lo, hi = tree.spans[leaf]
        active = np.flatnonzero(bounds[:, leaf] * factor <= reach(found.kth()))
        if not len(active):
            continue
        work += len(active) * (hi - lo)
        sims = thin[active] @ narrow[lo:hi].T
        limit = found.kth()[active]
        if hi - lo > 2 * found.k and np.isneginf(limit).any():
            limit = np.maximum(limit, -np.partition(-sims, found.k, axis=1)[:, found.k])
        row, col = np.nonzero(sims >= (limit - SLACK).astype(np.float32)[:, None])
        point = tree.order[lo + col]
        other = ids[point] != query_ids[active[row]]
        row, point = active[row[other]], point[other]
        exact = np.round(np.einsum("ij,ij->i", queries[row], tree.points[point]), DIGITS)
        found.offer(row, exact, ids[point])
    return work


@dataclass(frozen=True)
class Settings:
    """What the search depends on."""

    k: int = 5
    dimension: int = 64
    factor: float = 4.0
    shard_rows: int = SHARD_ROWS


_RESULT = pa.schema([
    ("kind", pa.int32()), ("group", pa.string()), ("shard", pa.int32()), ("salt", pa.int32()), ("id", pa.int64()), ("copy", pa.int64()),
    ("vector", pa.binary()), ("sim", pa.float64()), ("near", pa.list_(pa.struct([("neg", pa.float64()), ("id", pa.int64())]))),
])
_RESULT_DDL = "kind int, group string, shard int, salt int, id long, copy long, vector binary, sim double, near array<struct<neg: double, id: long>>"
RESULT, VISIT, EXTRA, SPLIT = 0, 1, 2, 3
SALTS = 64
PUSHED_GROUPS = 1000


def _near(found: Found) -> pa.Array:
    real = ~np.isneginf(found.sims)
    offsets = np.concatenate([[0], np.cumsum(real.sum(axis=1))]).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(-found.sims[real]), pa.array(found.ids[real])], names=["neg", "id"])
    return pa.ListArray.from_arrays(pa.array(offsets), pairs)


def _rows(kind: int, group: str, shard: np.ndarray | int, ids: np.ndarray, **more: pa.Array) -> pa.RecordBatch:
    n = len(ids)
    columns = {"kind": pa.array(np.full(n, kind, np.int32)), "group": pa.array([group] * n, pa.string()), "shard": pa.array(np.broadcast_to(np.asarray(shard, np.int32), n)), "id": pa.array(ids)} | more
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _RESULT], schema=_RESULT)


def _prepare(settings: Settings, routes: dict[str, Tree]):
    """Usable vectors as (group, shard, id, copy, vector); in each batch, copies of one vector beyond the k + 1 smallest ids lose the vector."""
    d, most = settings.dimension, settings.k + 1
    schema = pa.schema([("group", pa.string()), ("shard", pa.int32()), ("id", pa.int64()), ("copy", pa.int64()), ("vector", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            nulls = np.zeros(len(lists.flatten()), bool) if not lists.flatten().null_count else np.asarray(lists.flatten().is_null())
            flat = lists.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.float32)
            starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
            right = np.flatnonzero((lengths == d) & np.asarray(batch.column("id").is_valid()))
            take = starts[right][:, None] + np.arange(d)
            rows = flat[take].reshape(-1, d)
            sound = np.isfinite(rows).all(axis=1) & ~nulls[take].any(axis=1).reshape(-1) & (rows != 0).any(axis=1)
            right, rows = right[sound], np.ascontiguousarray(rows[sound] + np.float32(0.0))
            if not len(right):
                continue
            ids = batch.column("id").to_numpy(zero_copy_only=False)[right].astype(np.int64)
            groups = np.array(batch.column("group").take(pa.array(right)).to_pylist(), object)
            order = np.argsort(ids, kind="stable")
            ids, groups, rows = ids[order], groups[order], rows[order]
            ids_again = np.zeros(len(ids), bool)
            keys = [(g, r.tobytes()) for g, r in zip(groups, rows)]
            seen: dict[tuple[str, bytes], int] = {}
            last: dict[tuple[str, bytes], int] = {}
            surplus = np.zeros(len(ids), bool)
            for i, key in enumerate(keys):
                if last.get(key) == ids[i]:
                    ids_again[i] = True
                    continue
                last[key] = ids[i]
                seen[key] = seen.get(key, 0) + 1
                surplus[i] = seen[key] > most
            shards = np.zeros(len(ids), np.int32)
            for group in set(groups) & routes.keys():
                mine = np.flatnonzero(groups == group)
                shards[mine] = routes[group].route(unit(rows[mine]))
            keep = ~ids_again
            copies = np.fromiter((hash_bytes(k[1]) if s else 0 for k, s in zip(keys, surplus)), np.int64, len(keys))
            vectors = [None if s else k[1] for k, s in zip(keys, surplus)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(groups, pa.string()), pa.array(shards), pa.array(ids), pa.array(copies), pa.array(vectors, pa.binary())], schema=schema
            ).filter(pa.array(keep))

    return run


def hash_bytes(data: bytes) -> int:
    """Signed 64-bit hash of a vector's bytes, the same in every process."""
    import xxhash

    return int.from_bytes(xxhash.xxh64(data, seed=3).digest(), "big", signed=True)


def _shards(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[tuple, dict[str, pa.ChunkedArray]]]:
    """Runs of equal (group, shard, salt) of rows that come sorted by them; queries of a run may come in several parts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        group, shard, salt = (np.array(batch.column(c).to_pylist(), object) for c in ("group", "shard", "salt"))
        change = np.flatnonzero((group[1:] != group[:-1]) | (shard[1:] != shard[:-1]) | (salt[1:] != salt[:-1])) + 1
        edges = [0, *change, batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            yield (group[lo], shard[lo], salt[lo]), {c: batch.column(c).slice(lo, hi - lo) for c in columns}


def _decode(vectors: pa.Array, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors.to_pylist()), np.float32).reshape(-1, dimension)


class Shard:
    """Members of one shard: distinct vectors with up to k + 1 smallest ids each, and their tree."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, settings: Settings) -> None:
        self.k = settings.k
        keys = np.ascontiguousarray(raw).view(np.dtype((np.void, raw.dtype.itemsize * raw.shape[1]))).ravel()
        inverse = np.unique(keys, return_inverse=True)[1].ravel()
        order = np.lexsort((ids, inverse))
        ids, raw, inverse = ids[order], raw[order], inverse[order]
        fresh = np.ones(len(ids), bool)
        fresh[1:] = (ids[1:] != ids[:-1]) | (inverse[1:] != inverse[:-1])
        ids, raw, inverse = ids[fresh], raw[fresh], inverse[fresh]
        place = np.arange(len(ids)) - np.searchsorted(inverse, inverse)
        extra = place > settings.k
        self.extra_ids = ids[extra]
        self.extra_of = inverse[extra]
        self.ids, self.raw, self.inverse = ids[~extra], raw[~extra], inverse[~extra]
        self.points = unit(self.raw)
        self.tree = Tree(self.points)
        self.narrow = self.points[self.tree.order].astype(np.float32)

    def own(self, factor: float) -> Iterator[tuple[np.ndarray, Found]]:
        """Neighbours within the shard of its own members, leaf by leaf."""
        for lo, hi in self.tree.spans:
            rows = self.tree.order[lo:hi]
            found = Found(len(rows), self.k)
            search(self.tree, self.narrow, self.ids, self.points[rows], self.ids[rows], found, factor)
            yield rows, found

    def copies(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of vectors with more than k copies: (rows of the k + 1 smallest ids)."""
        counts = np.bincount(self.inverse) if len(self.inverse) else np.zeros(0, int)
        for number in np.flatnonzero(counts > self.k):
            lo = int(np.searchsorted(self.inverse, number))
            yield np.arange(lo, lo + counts[number]), self.extra_ids[self.extra_of == number]


def _marks(wanted: np.ndarray) -> np.ndarray:
    """Per query and host, the wanted shards of the host as bits."""
    n, shards = wanted.shape
    hosts = -(-shards // HOST_SHARDS)
    padded = np.zeros((n, hosts * HOST_SHARDS), np.int64)
    padded[:, :shards] = wanted
    return padded.reshape(n, hosts, HOST_SHARDS) @ (1 << np.arange(HOST_SHARDS, dtype=np.int64))


def _search_own(settings: Settings, routes: dict[str, Tree], salts: dict[str, int]):
    """Each shard against itself; of split groups also the visits to other shards that the bound doesn't rule out."""

    def finish(key: tuple, parts: list[dict[str, pa.Array]]) -> Iterator[pa.RecordBatch]:
        group, number, _ = key
        ids = np.concatenate([p["id"].to_numpy() for p in parts])
        shard = Shard(ids, np.concatenate([_decode(p["vector"], settings.dimension) for p in parts]), settings)
        route = routes.get(group)
        copy, single = np.zeros(len(shard.ids), np.int64), np.ones(len(shard.ids), bool)
        for rows, extra in shard.copies():
            copy[rows[0]], single[rows[0]] = hash_bytes(shard.raw[rows[0]].tobytes()), False
            if len(extra):
                yield _rows(EXTRA, group, number, extra, copy=pa.array(np.full(len(extra), copy[rows[0]])))
        itself = np.round(np.einsum("ij,ij->i", shard.points, shard.points), DIGITS)
        for rows, found in shard.own(settings.factor):
            first = {"copy": pa.array(copy[rows], mask=single[rows]), "sim": pa.array(itself[rows], mask=single[rows])}
            yield _rows(RESULT if route is None else SPLIT, group, number, shard.ids[rows], near=_near(found), **first)
            if route is not None:
                bounds = route.bounds(shard.points[rows]) * settings.factor <= reach(found.kth())[:, None]
                bounds[:, number] = False
                marks = _marks(bounds)
                query, host = np.nonzero(marks)
                if len(query):
                    vectors = [shard.raw[r].tobytes() for r in rows]
                    salt = (shard.ids[rows[query]] % salts[group]).astype(np.int32)
                    yield _rows(VISIT, group, host, shard.ids[rows[query]], copy=pa.array(marks[query, host]), salt=pa.array(salt), vector=pa.array([vectors[q] for q in query], pa.binary()), sim=pa.array(found.kth()[query]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for now, part in _shards(batches, ("id", "copy", "vector")):
            if now[2]:  # copies without their vector
                yield _rows(EXTRA, now[0], now[1], part["id"].to_numpy(), copy=part["copy"])
                continue
            if key is not None and now != key:
                yield from finish(key, parts)
                parts = []
            key = now
            parts.append(part)
        if parts:
            yield from finish(key, parts)

    return run


def _hosts(settings: Settings, routes: dict[str, Tree], salts: dict[str, int]):
    """Members of the groups that have several shards, by host, once for each part that the host's visits are split in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _prepare(settings, routes)(batches):
            groups = np.array(batch.column("group").to_pylist(), object)
            whole = np.asarray(batch.column("vector").is_valid())
            for group in set(groups) & routes.keys():
                mine = batch.filter(pa.array((groups == group) & whole))
                shard = mine.column("shard").to_numpy()
                for salt in range(salts[group]):
                    yield _rows(RESULT, group, shard // HOST_SHARDS, mine.column("id").to_numpy(), salt=pa.array(np.full(mine.num_rows, salt, np.int32)), copy=pa.array(shard.astype(np.int64) % HOST_SHARDS), vector=mine.column("vector"))

    return run


def _visit(shards: dict[int, Shard], some: dict[str, pa.Array], settings: Settings) -> Iterator[tuple[np.ndarray, Found]]:
    """What visiting queries find in the shards of one host, in blocks: (ids, found)."""
    nothing = np.iinfo(np.int64).max
    all_ids, points, limits, marks = some["id"].to_numpy(), unit(_decode(some["vector"], settings.dimension)), some["sim"].to_numpy(), some["copy"].to_numpy()
    for lo in range(0, len(all_ids), 2048):
        block = slice(lo, lo + 2048)
        ids, found = all_ids[block], Found(len(all_ids[block]), settings.k)
        found.sims[:, -1] = limits[block]
        for number, shard in shards.items():
            rows = np.flatnonzero(marks[block] >> number & 1)
            if len(rows):
                part = Found(len(rows), settings.k, found.sims[rows])
                part.ids = found.ids[rows]
                search(shard.tree, shard.narrow, shard.ids, points[block][rows], ids[rows], part, settings.factor)
                found.sims[rows], found.ids[rows] = part.sims, part.ids
        found.sims[found.ids == nothing] = -np.inf
        hit = np.flatnonzero((found.ids != nothing).any(axis=1))
        if len(hit):
            kept = Found(len(hit), settings.k, found.sims[hit])
            kept.ids = found.ids[hit]
            yield ids[hit], kept


def _search_visits(settings: Settings):
    """Members of a host come first in each run, then the visiting queries, which stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, shards = None, [], {}
        for now, part in _shards(batches, ("id", "vector", "sim", "kind", "copy")):
            if now != key:
                key, members, shards = now, [], {}
            visiting = part["kind"].to_numpy() == VISIT
            hosted, some = ({c: v.filter(pa.array(visiting == which)) for c, v in part.items()} for which in (False, True))
            if len(hosted["id"]):
                members.append(hosted)
            if not len(some["id"]):
                continue
            if members:
                ids, vectors = np.concatenate([m["id"].to_numpy() for m in members]), np.concatenate([_decode(m["vector"], settings.dimension) for m in members])
                of = np.concatenate([m["copy"].to_numpy() for m in members])
                shards, members = {int(n): Shard(ids[of == n], vectors[of == n], settings) for n in np.unique(of)}, []
            for ids, found in _visit(shards, some, settings):
                yield _rows(RESULT, now[0], now[1], ids, near=_near(found))

    return run


def nearest(vectors: DataFrame, group: str, key: str, vector: str, settings: Settings = Settings()) -> DataFrame:
    """The k most similar other vectors of the same group for every usable vector.

    Usable: exactly ``dimension`` finite, non-null elements, not all zero, and a non-null group
    and key. Equal similarities (to 12 digits) are ranked by the smaller key; a key delivered again
    counts once. A group of fewer than k + 1 vectors gives what there is. An empty table gives
    no rows; other columns aren't read.

    ``factor`` relaxes the pruning: at one the result is exact; above, a neighbour is missed if
    its leaf's bound times the factor exceeds the distance of the k-th found so far.

    Returns (group, key, near array<struct<neg: double, id: long>>) with neg = -cosine, best first.

    Scale: a group of over ``shard_rows`` vectors is split by a routing tree, fitted on a
    bounded sample (64 vectors a shard, 100,000 in all) and broadcast (one vector a shard, of at most 100,000 shards:
    with more vectors, shards grow); every vector is indexed. A query goes to another shard only if the bound doesn't rule it
    out, with the k-th similarity found at home; eight shards are one host, to which a query goes once. Copies of one vector beyond the k + 1
    smallest keys can be nobody's neighbour: they travel without their vector, salted, and take
    the result of their first copies by a join.
    """
    spark = vectors.sparkSession
    source = vectors.select(F.col(group).cast("string").alias("group"), F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("embedding")).where("group IS NOT NULL AND id IS NOT NULL AND embedding IS NOT NULL")
    large = {r["group"]: r["count"] for r in source.groupBy("group").count().where(F.col("count") > settings.shard_rows).collect()}
    while sum(large.values()) > settings.shard_rows * MAX_SHARDS // 2:
        settings = replace(settings, shard_rows=settings.shard_rows * 2)
        large = {g: n for g, n in large.items() if n > settings.shard_rows}
    routes = _routes(source, large, settings)
    salts = {g: max(1, n // SALT_ROWS) for g, n in large.items()}
    shared = spark.sparkContext.broadcast((routes, salts))
    ready_ddl = "group string, shard int, id long, copy long, vector binary"
    ready = source.mapInArrow(lambda it: _prepare(settings, shared.value[0])(it), ready_ddl)
    salted = ready.withColumn("salt", F.when(F.col("vector").isNull(), F.pmod("id", F.lit(SALTS)).cast("int") + 1).otherwise(0))
    shards = salted.repartition("group", "shard", "salt").sortWithinPartitions("group", "shard", "salt", "id")
    at_home = cut_lineage(shards.mapInArrow(lambda it: _search_own(settings, *shared.value)(it), _RESULT_DDL))
    results = at_home.where(F.col("kind") == RESULT).select("group", "id", "near")
    further = at_home.where(F.col("kind") == EXTRA).select("group", "copy", "id").distinct()
    # A surplus copy's neighbours are those of the first copy and that one itself.
    with_itself = F.slice(F.array_sort(F.array_append("near", F.struct((-F.col("sim")).alias("neg"), "id"))), 1, settings.k).alias("near")

    def copied(firsts: DataFrame) -> DataFrame:
        lists = firsts.where("copy IS NOT NULL").select("group", "copy", with_itself)
        return further.join(lists, ["group", "copy"]).where("NOT exists(near, x -> x.id = id)").select("group", "id", "near")

    at_once = results.unionAll(copied(at_home.where(F.col("kind") == RESULT)))
    if not routes:
        return _named(at_once, group, key)
    few = source.where(F.col("group").isin(list(routes))) if len(routes) <= PUSHED_GROUPS else source
    columns = ("group", "shard", "salt", "kind", "id", "copy", "vector", "sim")
    hosts = few.mapInArrow(lambda it: _hosts(settings, *shared.value)(it), _RESULT_DDL).select(*columns)
    visits = at_home.where(F.col("kind") == VISIT).select(*columns)
    away = (
        hosts.unionAll(visits).repartition("group", "shard", "salt").sortWithinPartitions("group", "shard", "salt", "kind", "id")
        .mapInArrow(lambda it: _search_visits(settings)(it), _RESULT_DDL).select("group", "id", "copy", "sim", "near")
    )
    best = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, settings.k).alias("near")
    halves = at_home.where(F.col("kind") == SPLIT).select("group", "id", "copy", "sim", "near").unionAll(away)
    merged = halves.groupBy("group", "id").agg(F.max("copy").alias("copy"), F.max("sim").alias("sim"), best)
    return _named(at_once.unionAll(merged.select("group", "id", "near")).unionAll(copied(merged)), group, key)


def _named(df: DataFrame, group: str, key: str) -> DataFrame:
    return df.select(F.col("group").alias(group), F.col("id").alias(key), "near")


def _shard_count(n: int, settings: Settings) -> int:
    return 2 ** int(np.ceil(np.log2(n / settings.shard_rows)))


def _routes(source: DataFrame, large: dict[str, int], settings: Settings) -> dict[str, Tree]:
    """A routing tree for each group that needs several shards, from a bounded sample."""
    if not large:
        return {}
    share = min(1.0, 2 * SAMPLE_PER_SHARD / settings.shard_rows, MAX_SAMPLE / sum(large.values()))
    draw = F.pmod(F.xxhash64(F.lit(29), "id"), F.lit(2**31)) / F.lit(float(2**31))
    few = source.where(F.col("group").isin(list(large))) if len(large) <= PUSHED_GROUPS else source
    drawn = few.where(draw < share).where(F.size("embedding") == settings.dimension)
    by_group: dict[str, list] = {}
    for r in drawn.select("group", "embedding").limit(2 * MAX_SAMPLE).collect():
        if r["group"] in large and None not in r["embedding"]:
            by_group.setdefault(r["group"], []).append(r["embedding"])
    routes = {}
    for group in large:
        sample = np.array(by_group.get(group, []), np.float32).reshape(-1, settings.dimension)
        sample = sample[np.isfinite(sample).all(axis=1) & (sample != 0).any(axis=1)]
        if len(sample) < 2:
            continue
        tree = Tree(unit(np.unique(sample, axis=0)), leaf=1, depth=int(np.log2(_shard_count(large[group], settings))))
        tree.path = [tuple((n, 0.0 if i == 0 else lo, hi) for i, (n, lo, hi) in enumerate(p)) for p in tree.path]
        routes[group] = _widened(tree)
    return routes


def _widened(tree: Tree) -> Tree:
    """Intervals of a tree that also holds vectors outside its sample: the two sides of a node meet half-way and reach to the ends of what distances there are."""
    limits: dict[int, list[tuple[float, float]]] = {}
    for path in tree.path:
        for number, low, high in path:
            limits.setdefault(number, []).append((low, high))
    middle = {}
    for number, spans in limits.items():
        inner, outer = min(spans, key=lambda s: s[1]), max(spans, key=lambda s: s[1])
        middle[number] = (inner[1] + outer[0]) / 2
    tree.path = [tuple((n, 0.0, middle[n]) if high <= middle[n] else (n, middle[n], 2.0) for n, _, high in path) for path in tree.path]
    tree.points = tree.points[:0]
    return tree
