"""Visits, repeat appearances and pauses: grouping ordered rows by the time between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import lag_then_group, lagged


def _order(df: DataFrame, ts: str, tie: list[str]) -> tuple[DataFrame, list[str]]:
    """Order by ``ts`` with null times last, then by ``tie``."""
    return df.withColumn("_no_ts", F.col(ts).isNull()), ["_no_ts", ts, *tie]


def _new_group(gap: Column, prev: Column, limit, strict: bool) -> Column:
    over = gap > limit if strict else gap >= limit
    return F.when(over | prev.isNull(), 1).otherwise(0)


def gap_flag(
    df: DataFrame, key: str, ts: str, gap: Column, tie: list[str], strict: bool = True
) -> DataFrame:
    """Previous time per key and ``is_new`` = 1 where a new visit starts.

    A visit starts when nothing precedes it or the gap is above the limit (``strict``) or reaches it.
    """
    ordered, order = _order(df, ts, tie)
    out = lagged(ordered, [key], order, ts, "prev_ts").drop("_no_ts")
    return out.withColumn("is_new", _new_group(F.col(ts) - F.col("prev_ts"), F.col("prev_ts"), gap, strict))


def gap_groups(
    df: DataFrame, key: str, ts: str, gap: Column, tie: list[str], strict: bool = True
) -> DataFrame:
    """``gap_flag`` plus ``group_id``, the running number of the visit within its key."""
    ordered, order = _order(df, ts, tie)
    return lag_then_group(
        ordered,
        [key],
        order,
        ts,
        lambda d: _new_group(d[ts] - d["prev_ts"], d["prev_ts"], gap, strict),
        group="group_id",
        prev="prev_ts",
    ).drop("_no_ts", "place")


def visit_counts(df: DataFrame, key: str, ts: str, gap: Column, tie: list[str], strict: bool = True) -> DataFrame:
    """Number of visits per key. Each visit has exactly one starting row, so the flags are summed
    and no distinct count over group ids is needed."""
    flagged = gap_flag(df.select(key, ts, *tie), key, ts, gap, tie, strict)
    return flagged.groupBy(key).agg(F.sum("is_new").alias("groups_count"))


def plate_visits(
    events_media: DataFrame, plate: str = "PLATE_NO", ts: str = "start_time", tie: tuple[str, ...] = ("id",)
) -> DataFrame:
    """Visits per licence plate, identified by its characters 2 to 4, with a gap above one minute.

    Unreadable plates are removed before the window. They are usually the largest group, and as the
    condition is on the window key the result is the same as filtering afterwards.
    """
    digits = F.substring(plate, 2, 3)
    readable = events_media.select(digits.alias("plate_digits"), F.col(ts), *tie).filter(
        F.col("plate_digits").isNotNull() & ~F.col("plate_digits").isin("", "___")
    )
    return visit_counts(readable, "plate_digits", ts, F.expr("interval 1 minute"), list(tie)).orderBy(
        F.desc("groups_count"), "plate_digits"
    )


def max_gap(df: DataFrame, key: str, ts: str, tie: list[str]) -> DataFrame:
    """Largest time between two consecutive rows of a key; zero for a single row."""
    ordered, order = _order(df.select(key, ts, *tie), ts, tie)
    prev = lagged(ordered, [key], order, ts, "prev_ts")
    step = F.timestamp_diff("MICROSECOND", F.col("prev_ts"), F.col(ts))
    return prev.groupBy(key).agg(
        F.coalesce(F.max(step), F.lit(0)).alias("max_gap_us"),
        F.min(ts).alias("first_seen"),
        F.max(ts).alias("last_seen"),
        F.count(F.lit(1)).alias("appearances"),
    )
