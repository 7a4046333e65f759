"""Problem 2: differences of snapshots against brute force, and its edge cases."""

import datetime as dt
import random

from pyspark.sql import functions as F

from stratalith.functions.types import comparable_type
from stratalith.operators.snapshots import snapshot_changes

SCHEMA = "schema_id string, id string, snapshot_no int, delivered_at timestamp, type string, nullable boolean, snap string, change string"


def run(spark, rows, values=False):
    df = spark.createDataFrame(rows, SCHEMA)
    return snapshot_changes(df, "schema_id", "id", "snapshot_no", "delivered_at", {"type": comparable_type(F.col("type")), "nullable": F.col("nullable")}, values)


def at(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


def brute(rows):
    held = {}
    for s, i, n, d, t, u, *_ in sorted(rows, key=lambda r: r[3]):
        if s is not None and i is not None and n is not None:
            held[s, n, i] = (None if t is None else t.strip(" \t").lower(), u)
    out = set()
    for s in {k[0] for k in held}:
        numbers = sorted({k[1] for k in held if k[0] == s})
        for a, b in zip(numbers, numbers[1:]):
            old, new = ({k[2]: v for k, v in held.items() if k[:2] == (s, n)} for n in (a, b))
            out |= {(s, i, a, b, "added") for i in new.keys() - old.keys()} | {(s, i, a, b, "removed") for i in old.keys() - new.keys()}
            out |= {(s, i, a, b, "changed") for i in old.keys() & new.keys() if old[i] != new[i]}
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for n in range(600):
        group = rng.choice(["hot"] * 5 + ["a", "b", None])
        rows.append((group, rng.choice([None, *"pqrstu"]), rng.choice([1, 2, 3, 5, 9]), at(n), rng.choice(["text", "TEXT ", "\tinteger", None]), rng.choice([True, False, None]), "x", "y"))
    found = [tuple(r) for r in run(spark, rows).collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows)


def test_late_and_corrected_rows_null_values_and_spelling(spark):
    rows = [
        ("s", "a", 1, at(0), "character varying(4)", True, None, None), ("s", "a", 2, at(9), "VARCHAR(4) ", True, None, None),
        ("s", "b", 1, at(0), None, None, None, None), ("s", "b", 2, at(1), "text", None, None, None), ("s", "b", 2, at(2), None, None, None, None),
        ("s", "c", 1, at(5), "text", None, None, None), ("s", "c", 2, at(1), "text", False, None, None),
        ("t", "a", 7, at(0), "text", True, None, None),
    ]
    assert [tuple(r) for r in run(spark, rows, values=True).collect()] == [("s", "c", 1, 2, "changed", "text", "text", None, False)]


def test_equal_delivery_times_give_one_stable_result(spark):
    rows = [("s", "a", 1, at(0), "text", True, "", ""), ("s", "a", 2, at(0), "text", True, "", ""), ("s", "a", 2, at(0), "uuid", True, "", "")]
    found = run(spark, rows).collect()
    assert found == run(spark, rows[::-1]).collect() and len(found) <= 1


def test_repeated_rows_and_missing_delivery_time(spark):
    rows = [("s", "a", 1, None, "text", True, "", "")] * 3 + [("s", "a", 1, at(1), "uuid", True, "", ""), ("s", "a", 2, None, "uuid", True, "", "")]
    assert run(spark, rows).collect() == []


def test_empty_table(spark):
    assert run(spark, []).collect() == []
