"""Vector functions as columns, in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalith.functions.text import fnv1a


def dot(a: Column, b: Column) -> Column:
    """Sum of products."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null where a length is zero (X-11, F13)."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z, 0-9 and underscore."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), 0)


def token_buckets(text: Column, dimensions: int) -> Column:
    """Bucket of every token: lower-case runs of a-z, 0-9 and underscore, by FNV-1a."""
    return F.transform(tokens(text), lambda t: F.pmod(fnv1a(t), F.lit(dimensions)).cast("int"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it: a lambda's variable holds it."""
    return F.transform(F.array(value), use)[0]


def hashed_embedding(text: Column, dimensions: int = 64) -> Column:
    """Counts per bucket at length one (A12, E9); all zero for a null text and one without tokens."""
    places = F.sequence(F.lit(0), F.lit(dimensions - 1))
    counted = lambda b: F.transform(places, lambda i: (F.size(b) - F.size(F.array_remove(b, i))).cast("double"))
    scaled = lambda c: _once(norm(c), lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(0.0).cast("float")))
    return _once(_once(token_buckets(F.coalesce(text, F.lit("")), dimensions), counted), scaled)
