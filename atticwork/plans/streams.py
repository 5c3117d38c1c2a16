"""Streaming queries over ``events`` as a file stream, run to the end of what is there.

The tables have an end, so what is open there is closed and every visit and window comes out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import leads as ld
from ..session import shared_dir
from ..streaming import events as s
from .camera import messages, recognition
from .catalog import Tables, query
from .files import requests


def stream(t: Tables) -> DataFrame:
    return s.table_stream(t.spark, t.directory, "events")


class _Streamed(Tables):
    """Tables where ``events`` and ``pages`` arrive as streams."""

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("events", "pages"):
            return s.table_stream(self.spark, self.directory, name)
        return super().__getattr__(name)


def _streamed(t: Tables) -> Tables:
    return _Streamed(t.spark, t.directory)


_VISITS = """
    WITH d AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
    g AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev {op} INTERVAL {gap} THEN 1 ELSE 0 END)
                 OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM d),
    closed AS (SELECT user_id, g, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events FROM g GROUP BY ALL)
"""


@query(
    _VISITS.format(op=">", gap="1 HOUR")
    + "SELECT user_id, strftime(first_ts, '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(last_ts, '%Y-%m-%d %H:%M:%S') AS last_ts, events FROM closed"
)
def streamed_visits(t: Tables) -> DataFrame:
    build = lambda df: s.visit_sessions(df, "user_id", "ts", "1 hour", "10 minutes")
    out = s.run_to_the_end(stream(t), "ts", build, "visits", at_once=True)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("user_id", stamp("first_ts"), stamp("last_ts"), "events")


@query(
    _VISITS.format(op=">=", gap="1 HOUR")
    + "SELECT user_id, strftime(first_ts, '%Y-%m-%d %H:%M:%S') AS first_ts, events FROM closed"
)
def streamed_visits_from_gap_on(t: Tables) -> DataFrame:
    build = lambda df: s.visit_sessions(df, "user_id", "ts", "1 hour", "10 minutes", strict=False)
    out = s.run_to_the_end(stream(t), "ts", build, "visits-from", at_once=True)
    return out.select("user_id", F.date_format("first_ts", "yyyy-MM-dd HH:mm:ss").alias("first_ts"), "events")


@query(
    _VISITS.format(op=">", gap="24 HOUR")
    + """, a AS (SELECT user_id AS person_id, lag(last_ts) OVER (PARTITION BY user_id ORDER BY first_ts) AS last_seen, first_ts AS seen_again FROM closed)
    SELECT person_id, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen, strftime(seen_again, '%Y-%m-%d %H:%M:%S') AS seen_again,
    round(date_diff('microsecond', last_seen, seen_again) / 3600000000.0, 3) AS gap_hours FROM a WHERE last_seen IS NOT NULL"""
)
def streamed_repeat_alerts(t: Tables) -> DataFrame:
    build = lambda df: s.repeat_alerts(s.visit_sessions(df, "user_id", "ts", "24 hours", "10 minutes"), "user_id")
    out = s.run_to_the_end(stream(t), "ts", build, "alerts", at_once=True)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("person_id", stamp("last_seen"), stamp("seen_again"), F.round("gap_hours", 3).alias("gap_hours"))


@query(
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS events FROM events GROUP BY ALL"""
)
def streamed_calendar_counts(t: Tables) -> DataFrame:
    out = s.run_to_the_end(stream(t), "ts", lambda df: s.calendar_counts_stream(df, "ts", ["event_type"], "10 minutes"), "calendar", at_once=True)
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "events")


@query(
    """WITH w AS (SELECT event_type, unnest([date_trunc('day', ts) + to_hours(12 * (hour(ts) // 12)), date_trunc('day', ts) + to_hours(12 * (hour(ts) // 12) - 12)]) AS s
        FROM events)
    SELECT strftime(s, '%Y-%m-%d %H') AS start, event_type, count(*) AS events FROM w GROUP BY ALL"""
)
def streamed_sliding_counts(t: Tables) -> DataFrame:
    build = lambda df: s.calendar_counts_stream(df, "ts", ["event_type"], "10 minutes", "1 day", "12 hours")
    out = s.run_to_the_end(stream(t), "ts", build, "sliding", at_once=True)
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("start"), "event_type", "events")


@query("SELECT DISTINCT sha256(props) AS data_hash FROM events WHERE props IS NOT NULL")
def streamed_ingest(t: Tables) -> DataFrame:
    """Which copy arrives first is open, which hashes are kept is not."""
    hashed = stream(t).withColumn("data_hash", F.sha2("props", 256))
    out = s.run_available(s.ingest_stream(hashed, ["data_hash"], "ts", "40 days"), "ingest")
    return out.select("data_hash")


@query(
    """WITH w AS (SELECT *, event_id % 3 AS wave FROM events),
    m AS (SELECT wave, max(ts) AS newest FROM w GROUP BY wave),
    x AS (SELECT w.event_id, w.wave, w.ts <= (SELECT max(newest) FROM m WHERE m.wave < w.wave) - INTERVAL 20 DAY AS late FROM w)
    SELECT event_id, wave FROM x WHERE late"""
)
def late_events(t: Tables) -> DataFrame:
    """All events, coming in three waves: those more than 20 days behind when they come."""
    folder = shared_dir(t.spark, "waves")
    events = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    waves = events.withColumn("wave", F.col("event_id") % 3)
    late = None
    for wave in range(3):
        waves.where(F.col("wave") == wave).write.mode("append").parquet(f"{folder}/in")
        arriving = t.spark.readStream.schema(waves.schema).parquet(f"{folder}/in")
        _, late = s.split_late(arriving, "ts", "20 days", f"{folder}/out")
    return late.select("event_id", "wave")


@query(
    """SELECT event_id AS id, 'cam' || CAST(user_id % 7 AS VARCHAR) AS camera, CASE event_type WHEN 'click' THEN 'car' ELSE 'dog' END AS labels
    FROM events WHERE event_type IN ('click', 'view') AND value > 20"""
)
def streamed_filter(t: Tables) -> DataFrame:
    out = s.run_available(s.filter_events(messages(_streamed(t)).select("id", "data"), ["car", "dog"]), "filter")
    return out.select("id", "camera", "labels")


@query("SELECT event_id AS id, CASE WHEN event_type = 'purchase' THEN 'DONE' ELSE '' END AS status FROM events")
def streamed_enrichment(t: Tables) -> DataFrame:
    own = stream(t).select("event_id", "ts")
    out = s.run_available(s.enrich(own, recognition(t).select("event_id", "status"), "event_id"), "enrich")
    return out.select(F.col("event_id").alias("id"), F.coalesce("status", F.lit("")).alias("status"))


@query(
    """WITH d AS (SELECT user_id, event_id, ts, ts + to_microseconds(CAST(1000000 * floor(value) AS BIGINT)) AS ends FROM events),
    e AS (SELECT *, lag(ends) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM d),
    g AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
                 OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS b FROM e),
    v AS (SELECT user_id, b, min(ts) AS block_start, max(ends) AS block_end, count(*) AS sentences FROM g GROUP BY ALL)
    SELECT user_id, strftime(block_start, '%Y-%m-%d %H:%M:%S') AS block_start, strftime(block_end, '%Y-%m-%d %H:%M:%S') AS block_end, sentences FROM v"""
)
def streamed_pause_blocks(t: Tables) -> DataFrame:
    """Events as utterances that last ``value`` seconds, a pause of half an hour between blocks."""
    build = lambda df: s.pause_blocks_stream(df, "user_id", "ts", "event_id", F.floor("value"), 1800, "10 minutes")
    out = s.run_to_the_end(stream(t), "ts", build, "pauses", at_once=True)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("user_id", stamp("block_start"), stamp("block_end"), "sentences")


@query(
    """SELECT page_id AS id, CASE WHEN url LIKE 'https%' THEN 'secure' ELSE 'UndefToken' END AS token,
    '7' || lpad(CAST(page_id AS VARCHAR), 4, '9') || CAST(length(html) AS VARCHAR) || CAST(page_id AS VARCHAR) AS phone FROM pages"""
)
def streamed_leads(t: Tables) -> DataFrame:
    leads = ld.append_leads(requests(_streamed(t)), F.lit(0))
    return s.run_available(leads, "leads").select("id", "token", "phone")
