"""Phone leads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

# The searchable columns and the sortable ones.
SEARCHED = ["phone", "token", "clientIP", "userAgent", "referer", "status"]
SORTABLE = ["id", "token", "phone", "clientIP", "userAgent", "referer", "status", "created_at"]


def append_leads(requests: DataFrame, now_ms: Column) -> DataFrame:
    """Requests with a phone as new lead rows: digits only, client address from the first header that
    has one, default token and status. Works on batches and streams."""

    def first_filled(*names: str) -> Column:
        return F.coalesce(*[F.when(F.col(n) != "", F.col(n)) for n in names])

    return requests.filter("phone is not null").select(
        "id",
        F.coalesce("token", F.lit("UndefToken")).alias("token"),
        t.digits_only("phone").alias("phone"),
        first_filled("x_real_ip", "x_forwarded_for", "remote_addr").alias("clientIP"),
        F.coalesce("user_agent", F.lit("")).alias("userAgent"),
        F.coalesce("referer", F.lit("")).alias("referer"),
        F.lit("new").alias("status"),
        now_ms.cast("long").alias("created_at"),
    )


def search_leads(df: DataFrame, search: str | None = None, since_ms: int | None = None) -> DataFrame:
    """Leads with the text in any of six columns, from a time on. A search with at least four digits
    looks for its digits only."""
    if search:
        digits = "".join(c for c in search if c.isdigit())
        needle = digits if len(digits) >= 4 else search
        df = df.filter(reduce(lambda a, b: a | b, [t.contains_ci(F.coalesce(c, F.lit("")), needle) for c in SEARCHED]))
    if since_ms is not None:
        df = df.filter(F.col("created_at") >= since_ms)
    return df


def lead_order(order: str | None) -> list[Column]:
    """``column`` or ``column:desc``; anything unknown means newest id first."""
    name, _, direction = (order or "").partition(":")
    if name not in SORTABLE:
        return [F.desc("id")]
    lead = F.desc(name) if direction.lower() == "desc" else F.asc(name)
    return [lead, F.asc("id")]


def show_leads(df: DataFrame) -> DataFrame:
    return df.withColumn("phone", t.phone_display("phone")).withColumn("created_at", F.timestamp_millis("created_at"))
