"""q-gram distance between names."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

Q = 3


def qgrams(col: Column | str, q: int = Q) -> Column:
    """Character q-grams of the lower-cased text, with repeats."""
    text = F.lower(col)
    count = F.length(text) - (q - 1)
    return F.when(
        count > 0,
        F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(text, i, F.lit(q))),
    ).otherwise(F.array().cast("array<string>"))


def qgram_distance(col: Column | str, query: str, q: int = Q) -> Column:
    """Symmetric difference of the two q-gram multisets over their total size, 0 (same) to 1.

    The query is a constant, so the shared part is a sum over its distinct grams. Two texts too short
    to have any gram are compared as they are.
    """
    lowered = query.lower()
    wanted = Counter(lowered[i : i + q] for i in range(len(lowered) - q + 1))
    total = sum(wanted.values())
    grams = qgrams(col, q)
    wanted_map = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair]) if wanted else None
    if wanted_map is None:
        shared = F.lit(0)
    else:
        shared = F.aggregate(
            F.map_entries(wanted_map),
            F.lit(0),
            lambda acc, e: acc + F.least(e["value"], F.size(F.filter(grams, lambda g: g == e["key"]))),
        )
    whole = F.size(grams) + total
    return F.when(whole > 0, (whole - 2 * shared) / whole).otherwise(
        F.when(F.lower(col) == lowered, 0.0).otherwise(1.0)
    )
