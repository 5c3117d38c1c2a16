"""Visits and repeat appearances over ``events`` (user = plate or person, event = sighting)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import gaps, people
from .catalog import Tables, query



def sightings(t: Tables) -> DataFrame:
    """Events with a plate: letter, three digits of the user, letters; unreadable for errors."""
    readable = F.concat(F.lit("K"), F.lpad(F.col("user_id").cast("string"), 3, "0"), F.lit("MM"))
    plate = F.when(F.col("event_type") == "error", "____").otherwise(readable)
    return t.events.select(F.col("event_id").alias("id"), plate.alias("PLATE_NO"), F.col("ts").alias("start_time"))


def seen(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("user_id").alias("person_id"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("name"),
        F.col("event_id").alias("asset_id"),
        F.col("ts").alias("file_created_at"),
    )


@query(
    """
    WITH p AS (
        SELECT event_id, ts, substring(CASE WHEN event_type = 'error' THEN '____'
               ELSE 'K' || lpad(CAST(user_id AS VARCHAR), 3, '0') || 'MM' END, 2, 3) AS plate_digits
        FROM events),
    d AS (
        SELECT *, lag(ts) OVER (PARTITION BY plate_digits ORDER BY ts, event_id) AS prev FROM p),
    g AS (
        SELECT *, sum(CASE WHEN ts - prev > INTERVAL 1 MINUTE OR prev IS NULL THEN 1 ELSE 0 END)
               OVER (PARTITION BY plate_digits ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS group_id FROM d)
    SELECT plate_digits, count(DISTINCT group_id) AS groups_count
    FROM g WHERE plate_digits IS NOT NULL AND plate_digits <> '' AND plate_digits <> '___'
    GROUP BY plate_digits
    """
)
def plate_visits(t: Tables) -> DataFrame:
    return gaps.plate_visits(sightings(t))


_GROUPS = """
    WITH d AS (
        SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
    f AS (
        SELECT *, CASE WHEN ts - prev {op} INTERVAL 1 HOUR OR prev IS NULL THEN 1 ELSE 0 END AS is_new FROM d),
    g AS (
        SELECT *, sum(is_new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS group_id FROM f)
"""


@query(_GROUPS.format(op=">") + "SELECT event_id, user_id, is_new, group_id FROM g")
def visit_groups(t: Tables) -> DataFrame:
    grouped = gaps.gap_groups(t.events.select("event_id", "user_id", "ts"), "user_id", "ts", F.expr("interval 1 hour"), ["event_id"])
    return grouped.select("event_id", "user_id", "is_new", "group_id")


@query(
    _GROUPS.format(op=">=")
    + "SELECT user_id, group_id, count(*) AS events, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts FROM g GROUP BY ALL"
)
def visits_from_gap_on(t: Tables) -> DataFrame:
    grouped = gaps.gap_groups(
        t.events.select("event_id", "user_id", "ts"), "user_id", "ts", F.expr("interval 1 hour"), ["event_id"], strict=False
    )
    return grouped.groupBy("user_id", "group_id").agg(
        F.count(F.lit(1)).alias("events"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_ts")
    )


@query(_GROUPS.format(op=">") + "SELECT event_id, user_id, is_new FROM g")
def visit_flags(t: Tables) -> DataFrame:
    flagged = gaps.gap_flag(t.events.select("event_id", "user_id", "ts"), "user_id", "ts", F.expr("interval 1 hour"), ["event_id"])
    return flagged.select("event_id", "user_id", "is_new")


_GAPS = """
    WITH d AS (
        SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
    m AS (
        SELECT user_id AS person_id, count(*) AS appearances, min(ts) AS first_seen, max(ts) AS last_seen,
               coalesce(max(date_diff('microsecond', prev, ts)), 0) AS max_gap_us
        FROM d GROUP BY user_id)
"""


@query(_GAPS + "SELECT person_id, appearances, max_gap_us FROM m")
def largest_gap(t: Tables) -> DataFrame:
    own = seen(t)
    return gaps.max_gap(own, "person_id", "file_created_at", ["asset_id"]).select("person_id", "appearances", "max_gap_us")


@query(
    _GAPS
    + """
    SELECT person_id, 'user ' || CAST(person_id AS VARCHAR) AS name, appearances,
           strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen,
           round(max_gap_us / 3600000000, 4) AS max_gap_hours
    FROM m WHERE max_gap_us > 48 * 3600000000
    """
)
def frequent_persons(t: Tables) -> DataFrame:
    found = people.frequent_persons(seen(t), 48)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return found.select(
        "person_id", "name", "appearances", stamp("first_seen"), stamp("last_seen"), F.round("max_gap_hours", 4).alias("max_gap_hours")
    )


@query(
    _GAPS
    + """
    , r AS (
        SELECT e.user_id AS person_id, e.event_id, row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS n
        FROM events e JOIN m ON m.person_id = e.user_id WHERE m.max_gap_us > 48 * 3600000000)
    SELECT person_id, (n - 1) // 1000 AS part, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY n) AS asset_ids
    FROM r GROUP BY ALL
    """
)
def frequent_person_assets(t: Tables) -> DataFrame:
    own = seen(t)
    parts = people.frequent_assets(own, people.frequent_persons(own, 48))
    return parts.select("person_id", "part", F.array_join("asset_ids", ",").alias("asset_ids"))


@query(
    _GAPS
    + "SELECT DISTINCT e.event_id AS asset_id FROM events e JOIN m ON m.person_id = e.user_id WHERE m.max_gap_us > 48 * 3600000000"
)
def assets_to_tag(t: Tables) -> DataFrame:
    own = seen(t)
    return people.assets_to_tag(own, people.frequent_persons(own, 48))


@query(
    _GAPS
    + """
    SELECT e.event_id AS id, CASE WHEN m.max_gap_us > 48 * 3600000000 THEN 'Frequent' ELSE '' END AS tags
    FROM events e JOIN m ON m.person_id = e.user_id
    """
)
def tagged_assets(t: Tables) -> DataFrame:
    own = seen(t)
    assets = t.events.select(F.col("event_id").alias("id"), F.array().cast("array<string>").alias("tags"))
    persons = t.customer.select(F.col("c_custkey").alias("id"), F.lit(False).alias("is_favorite"))
    tagged, _ = people.tag_frequent(assets, persons, own, people.frequent_persons(own, 48), "Frequent")
    return tagged.select("id", F.array_join("tags", ",").alias("tags"))


@query(
    _GAPS
    + """
    SELECT c_custkey AS id, CASE WHEN m.max_gap_us > 48 * 3600000000 THEN 1 ELSE 0 END AS is_favorite
    FROM customer LEFT JOIN m ON m.person_id = c_custkey
    """
)
def favorite_persons(t: Tables) -> DataFrame:
    own = seen(t)
    assets = t.events.select(F.col("event_id").alias("id"), F.array().cast("array<string>").alias("tags"))
    persons = t.customer.select(F.col("c_custkey").alias("id"), F.lit(False).alias("is_favorite"))
    _, liked = people.tag_frequent(assets, persons, own, people.frequent_persons(own, 48), "Frequent")
    return liked.select("id", F.col("is_favorite").cast("int").alias("is_favorite"))
