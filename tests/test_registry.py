"""Registered queries against their SQL on the smallest tables."""

import glob
import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SMALL


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value.replace(tzinfo=None).isoformat() if hasattr(value, "isoformat") else value


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SMALL}/*.parquet"):
        db.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return db


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    found = entry.queries()[name](spark, SMALL)
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    expected = cursor.fetchall()
    assert sorted(found.columns) == sorted(names)
    order = [found.columns.index(n) for n in names]
    assert Counter(tuple(plain(r[i]) for i in order) for r in found.collect()) == Counter(tuple(map(plain, r)) for r in expected)


def test_entry_and_queries_without_sql(spark):
    assert entry.entry(spark).limit(1).count() == 1
    for name in sorted(set(entry.queries()) - set(entry.oracle_sql())):
        assert entry.queries()[name](spark, SMALL).count() >= 0
