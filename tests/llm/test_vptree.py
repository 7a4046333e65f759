"""Problem 4: exact at factor one, recall at the default, copies and unusable vectors."""

import numpy as np
import pytest

from stratalith.llm.vptree import Found, Settings, Shard, Tree, nearest, unit

SCHEMA = "schema_id string, vec_id long, embedding array<float>, near string, id long"


def brute(rows, k=5):
    groups = {}
    for group, key, vector in rows:
        if group is not None and vector is not None and len(vector) == 64 and all(x is not None and np.isfinite(x) for x in vector) and any(vector):
            groups.setdefault(group, {})[key] = np.array(vector, np.float32)
    out = {}
    for group, members in groups.items():
        keys = np.array(sorted(members))
        points = unit(np.stack([members[i] for i in keys]))
        sims = np.round(np.einsum("ik,jk->ij", points, points), 12)
        np.fill_diagonal(sims, -9)
        for i, key in enumerate(keys):
            order = np.lexsort((keys, -sims[i]))
            out[group, int(key)] = [int(keys[j]) for j in order if keys[j] != key][:k]
    return out


def found(spark, rows, **settings):
    df = spark.createDataFrame([(g, i, v, "x", 0) for g, i, v in rows], SCHEMA)
    got = nearest(df.repartition(3), "schema_id", "vec_id", "embedding", Settings(**settings)).collect()
    assert len({(r["schema_id"], r["vec_id"]) for r in got}) == len(got)
    return {(r["schema_id"], r["vec_id"]): [x["id"] for x in r["near"]] for r in got}


def vectors(n, seed=0, groups=3, clusters=40):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, 64))
    data = centres[rng.integers(clusters, size=n)] + 0.4 * rng.normal(size=(n, 64))
    return [(f"g{rng.integers(groups)}" if i % 3 else "hot", i * 7, [float(x) for x in row.astype(np.float32)]) for i, row in enumerate(data)]


def test_factor_one_is_exact_even_when_split(spark):
    rows = vectors(1500)
    assert found(spark, rows, factor=1.0, shard_rows=120) == brute(rows)


def test_recall_at_the_default(spark):
    rows = vectors(3000, seed=1)
    got, want = found(spark, rows, shard_rows=400), brute(rows)
    assert got.keys() == want.keys()
    assert np.mean([len(set(got[i]) & set(want[i])) / 5 for i in want if want[i]]) >= 0.95


def test_copies_ties_redelivery_and_scaled_vectors(spark):
    rng = np.random.default_rng(2)
    base = [float(x) for x in rng.normal(size=64).astype(np.float32)]
    rows = [("a", i, base) for i in range(100, 0, -1)] + [("a", 1000 + i, [float(x) for x in rng.normal(size=64).astype(np.float32)]) for i in range(10)]
    rows += rows[:30] + [("a", 5000, [2 * x for x in base])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, shard_rows=40, factor=1.0) == brute(rows)


def test_unusable_vectors(spark):
    good = [1.0] + [0.0] * 63
    rows = [("a", 1, good), ("a", 2, good[:-1]), ("a", 3, [*good, 0.0]), ("a", 4, [0.0] * 64), ("a", 5, [float("nan"), *good[1:]]), ("a", 6, [float("inf"), *good[1:]]), ("a", 7, [None, *good[1:]]), ("a", 8, None), ("a", 9, []), (None, 10, good), ("a", None, good), ("b", 11, good)]
    assert found(spark, rows) == {("a", 1): [], ("b", 11): []}
    assert found(spark, []) == {}


def test_bounds_hold():
    points = unit(np.random.default_rng(3).normal(size=(900, 64)).astype(np.float32))
    tree = Tree(points, leaf=64)
    queries = unit(np.random.default_rng(4).normal(size=(50, 64)).astype(np.float32))
    bounds = tree.bounds(queries)
    for leaf, (lo, hi) in enumerate(tree.spans):
        nearest_of = np.linalg.norm(queries[:, None] - points[tree.order[lo:hi]][None], axis=2).min(1)
        assert (bounds[:, leaf] <= nearest_of + 1e-9).all()
    assert sorted(tree.order) == list(range(900))


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_small_shards(n):
    raw = np.random.default_rng(5).normal(size=(n, 64)).astype(np.float32)
    shard = Shard(np.arange(n), raw, Settings())
    assert sum(len(rows) for rows, _ in shard.own(1.0)) == n
    empty = Found(2, 3)
    empty.offer(np.array([0, 0]), np.array([0.5, 0.5]), np.array([9, 4]))
    assert empty.ids[0].tolist()[:2] == [4, 9] and np.isneginf(empty.sims[1]).all()


@pytest.mark.parametrize("shard_rows", [10_000, 40])
def test_surplus_copies_have_neighbours_that_are_no_copies(spark, shard_rows):
    rng = np.random.default_rng(7)
    base = [float(x) for x in rng.normal(size=64).astype(np.float32)]
    close = [float(np.nextafter(np.float32(base[0]), np.float32(9))), *base[1:]]
    rows = [("a", i, base) for i in range(10, 110)] + [("a", 1, [2 * x for x in base]), ("a", 2, close), ("a", 500, [4 * x for x in base])]
    rows += [("a", 1000 + i, [float(x) for x in rng.normal(size=64).astype(np.float32)]) for i in range(60)]
    got = found(spark, rows, shard_rows=shard_rows, factor=1.0)
    assert got == brute(rows) and 1 in got["a", 100]
