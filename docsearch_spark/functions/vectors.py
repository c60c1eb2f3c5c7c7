"""Vector expressions on ARRAY<FLOAT|DOUBLE> columns (no Python UDFs).

PySpark has no vector/cosine functions for arrays, so they are written with
higher-order functions; arithmetic is done in DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsearch_spark.functions.text import col_, let

NORM_EPS = 1e-12


def as_double(v) -> Column:
    return F.transform(col_(v), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine_similarity(a, b) -> Column:
    """dot / (|a| |b|); NULL when either vector is zero (no NaN, no error)."""
    return let(as_double(a), lambda x: let(as_double(b), lambda y: F.try_divide(
        dot(x, y), norm(x) * norm(y))))


def cosine_distance(a, b) -> Column:
    """``a <=> b``: 1 - cosine similarity, NULL for zero vectors."""
    return F.lit(1.0) - cosine_similarity(a, b)


def l2_distance(a, b) -> Column:
    d = F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x))


def l2_normalize(v, eps: float = NORM_EPS) -> Column:
    """``v / (|v| + eps)`` in DOUBLE; a zero vector stays zero."""
    return let(as_double(v), lambda d: let(norm(d) + F.lit(eps),
                                          lambda n: F.transform(d, lambda x: x / n)))


def score_from_distance(dist) -> Column:
    """``1 - dist``, NULL stays NULL."""
    return F.lit(1.0) - col_(dist)
