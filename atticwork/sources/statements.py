"""XML bank statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = """
BANKACCTFROM struct<ACCTID: string>,
BANKTRANLIST struct<STMTTRN: array<struct<
    TRNTYPE: string, DTPOSTED: string, DTAVAIL: string, TRNAMT: decimal(18,4),
    FITID: string, CHECKNUM: string, NAME: string, MEMO: string>>>
"""


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """Transactions with the account id of their statement and their position in it."""
    return (
        spark.read.format("xml").option("rowTag", "STMTRS").schema(_SCHEMA).load(path)
        .select(F.col("BANKACCTFROM.ACCTID").alias("account_id"), F.posexplode("BANKTRANLIST.STMTTRN").alias("position", "t"))
        .select("account_id", "position", "t.*")
    )
