"""Columnar and relational table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def read_tables(spark: SparkSession, directory: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: read_table(spark, directory, name) for name in names}


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    key: str,
    lower: int,
    upper: int,
    partitions: int,
    **options: str,
) -> DataFrame:
    """A relational table read by ranges of a numeric key, so that no single task reads it whole."""
    return (
        spark.read.format("jdbc")
        .option("url", url)
        .option("dbtable", table)
        .option("partitionColumn", key)
        .option("lowerBound", lower)
        .option("upperBound", upper)
        .option("numPartitions", partitions)
        .options(**options)
        .load()
    )


def register_views(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def run_sql(spark: SparkSession, text: str) -> DataFrame:
    """Run one ad-hoc statement over the registered views."""
    return spark.sql(text.strip().rstrip(";"))


def run_sql_file(spark: SparkSession, path: str) -> DataFrame:
    with open(path, encoding="utf-8") as handle:
        return run_sql(spark, handle.read())
