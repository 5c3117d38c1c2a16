"""Vector distance columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


def has_nan(a: Column | str) -> Column:
    return F.exists(a, lambda x: F.isnan(x))


def cosine_distance(a: Column, query: list[float]) -> Column:
    """1 − cosine similarity with a constant vector; null when either vector has no length.

    The length of the query is computed once here, so a row costs two passes over its own vector.
    """
    size = math.sqrt(sum(float(x) * float(x) for x in query))
    if size == 0:
        return F.lit(None).cast("double")
    q = F.array(*[F.lit(float(x)) for x in query])
    length = norm(a)
    return F.when(length > 0, F.greatest(1 - _dot(a, q) / (length * F.lit(size)), F.lit(0.0)))


def match_percent(distance: Column | str) -> Column:
    d = F.col(distance) if isinstance(distance, str) else distance
    return F.least(F.greatest((1 - d) * 100, F.lit(0.0)), F.lit(100.0))
