"""Pages, totals, sort keys and top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of an ordered DataFrame."""
    return df.offset((number - 1) * size).limit(size)


def page_totals(df: DataFrame, size: int) -> DataFrame:
    """Row count and page count, as an aggregate of its own: a window count would move every row into
    one task."""
    total = F.count(F.lit(1))
    return df.agg(total.alias("total"), F.ceil(total / size).alias("total_pages"))


def sort_by(df: DataFrame, key: str, allowed: dict[str, list[Column]], default: str) -> DataFrame:
    """Order by one of the named sort keys; an unknown name means the default."""
    return df.orderBy(*allowed.get(key, allowed[default]))


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """First ``n`` rows per key. For a row-number limit Spark keeps only ``n`` rows per key and task
    before the shuffle, so a hot key does not travel."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def most_recent(df: DataFrame, ts: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(ts), tie).limit(n)
