"""What changed between consecutive full snapshots (problem 2).

Keys and rows are reduced to 64-bit hashes on the JVM side; hash buckets of those
compact arrays are compared in numpy; full values are fetched only for the keys
that differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalith.session import cut_lineage

SUB_BUCKETS = 128
BROADCAST_PAIRS = 200_000
BROADCAST_CHANGES = 500_000
KINDS = np.array(["added", "removed", "changed"])
_COMPACT = ("k1", "k2", "place", "at", "row")


def _null_safe_hash(values: list[Column], seed: int) -> Column:
    """64-bit hash in which null differs from every value and from other nulls' places."""
    parts = [F.lit(seed)]
    for value in values:
        parts += [value.isNull(), value]
    return F.xxhash64(*parts)


def compare_bucket(a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Differences of one bucket. ``place`` is twice the number of the snapshot within its group (from 1), plus one if it is the group's last.

    Each key's rows are all in the bucket. Of several rows for one key and snapshot the last delivered holds (equal
    times: the greater row hash). ``to`` is the number of the later snapshot of the two.
    """
    order = np.lexsort((a["row"], a["at"], a["place"], a["k2"], a["k1"]))
    k1, k2, place, row = (a[name][order] for name in ("k1", "k2", "place", "row"))
    new_key = np.ones(len(k1), bool)
    new_key[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    last = np.ones(len(k1), bool)
    last[:-1] = new_key[1:] | (place[1:] != place[:-1])
    key = np.cumsum(new_key) - 1
    k1, k2, place, row, key = (x[last] for x in (k1, k2, place, row, key))
    at, final = place >> 1, (place & 1).astype(bool)
    width = int(at.max(initial=0)) + 2
    code = key * width + at

    def find(shift: int) -> tuple[np.ndarray, np.ndarray]:
        where = np.minimum(np.searchsorted(code, code + shift), len(code) - 1)
        return where, code[where] == code + shift

    before, in_before = find(-1)
    _, in_after = find(1)
    parts = [(at > 1) & ~in_before, ~final & ~in_after, (at > 1) & in_before & (row[before] != row)]
    pick = lambda values: np.concatenate([values[m] for m in parts])
    return {
        "k1": pick(k1), "k2": pick(k2), "to": np.concatenate([at[parts[0]], at[parts[1]] + 1, at[parts[2]]]).astype(np.int64),
        "change": np.repeat(np.arange(3), [int(m.sum()) for m in parts]),
    }


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by sub-bucket; one sub-bucket at a time is held."""
    held: list[dict[str, np.ndarray]] = []
    current: int | None = None

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            out = compare_bucket({name: np.concatenate([h[name] for h in held]) for name in _COMPACT})
            if len(out["k1"]):
                yield pa.RecordBatch.from_arrays([pa.array(out["k1"]), pa.array(out["k2"]), pa.array(out["to"]), pa.array(KINDS[out["change"]].tolist(), pa.string())], names=["k1", "k2", "to", "change"])
            held.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in (*_COMPACT, "sub")}
        sub = cols.pop("sub")
        edges = [0, *(np.flatnonzero(sub[1:] != sub[:-1]) + 1), len(sub)]
        for lo, hi in zip(edges, edges[1:]):
            if current is not None and sub[lo] != current:
                yield from flush()
            current = sub[lo]
            held.append({name: v[lo:hi] for name, v in cols.items()})
    yield from flush()


def snapshot_changes(df: DataFrame, group: str, key: str, snapshot: str, delivered: str, compare: dict[str, Column], values: bool = False) -> DataFrame:
    """Records added, removed or changed between each group's consecutive snapshots.

    The snapshots of a group are the numbers it has rows for; the first is compared
    with nothing. A row belongs to its snapshot however late it came; of several rows
    for one (group, snapshot, key) the last delivered holds, a null delivery time being
    the earliest. ``compare`` names the normalised columns whose difference makes a
    change; null is a value of its own. Rows without group, snapshot or key can't be
    placed and give nothing. An empty table gives no rows; other columns are ignored.

    Returns group, key, from_snapshot, to_snapshot, change; with ``values`` also
    ``old_<name>`` and ``new_<name>`` of each compared column.

    Scale: keys are spread over all partitions by hash, so a group that holds a third
    of the rows is split; only 40 bytes a row are shuffled for the comparison. The list of (group, snapshot)
    pairs and the changes are written to the shared folder and counted there; up to 200,000 pairs and 500,000 changes
    are broadcast, so that full values are read for differing keys only and without a shuffle; more are joined.
    """
    base = df.select(
        F.col(group).alias("_g"), F.col(key).alias("_k"), F.col(snapshot).cast("long").alias("snap"),
        F.coalesce(F.unix_micros(F.col(delivered).cast("timestamp")), F.lit(-(2**62))).alias("at"),
        *[c.alias(f"_v_{name}") for name, c in compare.items()],
    ).where("_g IS NOT NULL AND _k IS NOT NULL AND snap IS NOT NULL")
    base = base.withColumns({
        "k1": F.xxhash64(F.lit(1), "_g", F.lit(0), "_k"), "k2": F.hash(F.lit(7), "_k", F.lit(5), "_g").cast("long"),
        "row": _null_safe_hash([F.col(f"_v_{n}") for n in compare], 11),
    })
    in_group = Window.partitionBy("_g").orderBy("snap")
    numbered = base.select("_g", "snap").distinct().withColumns({"n": F.row_number().over(in_group).cast("long"), "prev": F.lag("snap").over(in_group), "more": F.lead("snap").over(in_group).isNotNull()})
    numbers = cut_lineage(numbered)
    few = lambda df, most: F.broadcast(df) if df.count() <= most else df
    steps = few(numbers, BROADCAST_PAIRS)
    compact = base.join(steps, ["_g", "snap"]).select("k1", "k2", (F.col("n") * 2 + (~F.col("more")).cast("long")).alias("place"), "at", "row")
    different = cut_lineage(
        compact.repartition("k1").withColumn("sub", F.pmod(F.shiftrightunsigned("k1", 32), F.lit(SUB_BUCKETS))).sortWithinPartitions("sub")
        .mapInArrow(_buckets, "k1 long, k2 long, to long, change string")
    )
    names = list(compare) if values else []
    source = base.select("k1", "k2", "snap", "at", "row", "_g", "_k", *[f"_v_{n}" for n in names]).join(few(different, BROADCAST_CHANGES), ["k1", "k2"])
    found = source.join(steps.select("_g", F.col("n").alias("to"), F.col("snap").alias("to_snapshot"), F.col("prev").alias("from_snapshot")), ["_g", "to"]).where("snap IN (from_snapshot, to_snapshot)")
    side = lambda name, at: F.max_by(F.when(F.col("snap") == F.col(at), F.struct(f"_v_{name}")), F.when(F.col("snap") == F.col(at), F.struct("at", "row")))[f"_v_{name}"]
    wide = found.groupBy("k1", "k2", "from_snapshot", "to_snapshot", "change").agg(
        F.first("_g").alias(group), F.first("_k").alias(key),
        *[side(n, "from_snapshot").alias(f"old_{n}") for n in names], *[side(n, "to_snapshot").alias(f"new_{n}") for n in names],
    )
    return wide.select(group, key, F.col("from_snapshot").cast("int"), F.col("to_snapshot").cast("int"), "change", *[f"{which}_{n}" for n in names for which in ("old", "new")])
