"""The catalogue of named queries over the driver tables, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table


class Tables:
    """Attribute access to the tables of one folder."""

    def __init__(self, spark: SparkSession, directory: str) -> None:
        self.spark = spark
        self.directory = directory

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, self.directory, name)


@dataclass(frozen=True)
class Query:
    fn: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, directory: str) -> DataFrame:
        return self.fn(Tables(spark, directory))


CATALOG: dict[str, Query] = {}


def query(sql: str | None = None):
    """Register a query under its function name."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if fn.__name__ in CATALOG:
            raise ValueError(f"query {fn.__name__} is registered twice")
        CATALOG[fn.__name__] = Query(fn, sql)
        return fn

    return register
