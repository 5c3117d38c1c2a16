"""Camera events: ``events`` wrapped into nested messages, flattened and filtered again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import camera as c
from .catalog import Tables, query

_LABELS = "CASE event_type WHEN 'click' THEN 'car' WHEN 'view' THEN 'dog' WHEN 'purchase' THEN 'cat' ELSE 'person' END"
_START = "CAST(epoch(ts) AS BIGINT)"


def messages(t: Tables) -> DataFrame:
    """Signups know only ``before``; purchases end; errors are not JSON. Clips exist above value 20."""
    label = F.expr("CASE event_type WHEN 'click' THEN 'car' WHEN 'view' THEN 'dog' WHEN 'purchase' THEN 'cat' ELSE 'person' END")
    start = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    id_ = F.concat(F.lit("ev"), F.col("event_id").cast("string"))

    def side(name: str, clip) -> F.Column:
        return F.struct(
            F.concat(F.lit(f"{name}-"), id_).alias("id") if name == "before" else id_.alias("id"),
            F.concat(F.lit("cam"), (F.col("user_id") % 7).cast("string")).alias("camera"),
            label.alias("label"),
            clip.alias("has_clip"),
            (F.col("value") > 10).alias("has_snapshot"),
            start.cast("double").alias("start_time"),
            F.when(F.col("event_type") == "purchase", start.cast("double") + 30).alias("end_time"),
        )

    before = side("before", F.lit(False))
    after = F.when(F.col("event_type") != "signup", side("after", F.col("value") > 20))
    body = F.to_json(F.struct(F.lit("update").alias("type"), before.alias("before"), after.alias("after")), {"ignoreNullFields": "false"})
    return t.events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("host"), (F.col("user_id") % 3).cast("string")).alias("source"),
        F.when(F.col("event_type") == "error", F.lit("not json {")).otherwise(body).alias("data"),
    )


def recognition(t: Tables) -> DataFrame:
    plate = F.concat(F.lit("K"), F.lpad(F.col("user_id").cast("string"), 3, "0"))
    result = F.to_json(F.struct(plate.alias("adjusted"), F.lower(plate).alias("detected"), F.array(plate, F.lit("other")).alias("plates")))
    return t.events.filter("event_type = 'purchase'").select(
        F.col("event_id").alias("event_id"), F.lit("DONE").alias("status"), result.alias("result")
    )


_FLAT = f"""
    e AS (SELECT *, {_LABELS} AS label, event_type = 'error' AS bad, event_type <> 'signup' AS has_after,
                 'host' || CAST(user_id % 3 AS VARCHAR) AS source FROM events)
"""


@query(
    f"""WITH {_FLAT}
    SELECT event_id AS id, CASE WHEN bad THEN '' ELSE 'update' END AS type,
        CASE WHEN bad THEN '' ELSE 'cam' || CAST(user_id % 7 AS VARCHAR) END AS camera, CASE WHEN bad THEN '' ELSE label END AS label,
        CASE WHEN bad THEN '' WHEN has_after THEN 'ev' || event_id ELSE 'before-ev' || event_id END AS event_id, source,
        CASE WHEN bad THEN -1 WHEN has_after AND value > 20 THEN 1 ELSE 0 END AS has_clip,
        CASE WHEN bad THEN '' ELSE concat_ws(', ',
            CASE WHEN has_after AND value > 20 THEN 'http://' || source || ':5000/api/events/ev' || event_id || '/clip.mp4' END,
            CASE WHEN value > 10 THEN 'http://' || source || ':5000/api/events/' || CASE WHEN has_after THEN '' ELSE 'before-' END || 'ev' || event_id || '/snapshot.jpg' END) END AS media,
        CASE WHEN bad OR NOT has_after THEN '' ELSE 'http://' || source || ':5000/api/events/ev' || event_id || '/thumbnail.jpg' END AS thumbnail_url,
        CASE WHEN bad THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS day, CASE WHEN bad THEN '' ELSE strftime(ts, '%Y-%m') END AS month,
        CASE WHEN bad THEN '' ELSE strftime(ts, '%a') END AS weekday,
        CASE WHEN event_type = 'purchase' THEN 'K' || lpad(CAST(user_id AS VARCHAR), 3, '0') ELSE '' END AS plate,
        CASE WHEN event_type = 'purchase' THEN 'K' || lpad(CAST(user_id AS VARCHAR), 3, '0') || ', other' ELSE '' END AS plates,
        CASE WHEN event_type = 'purchase' THEN 'DONE' ELSE '' END AS status
    FROM e"""
)
def events_media(t: Tables) -> DataFrame:
    flat = c.events_media(messages(t), recognition(t))
    text = lambda col, name: F.coalesce(F.col(col).cast("string"), F.lit("")).alias(name)
    return flat.select(
        "id", text("type", "type"), text("camera", "camera"), text("label", "label"), text("event_id", "event_id"), "source",
        F.coalesce(F.col("has_clip").cast("int"), F.lit(-1)).alias("has_clip"), text("media", "media"), text("thumbnail_url", "thumbnail_url"),
        text("start_date_date", "day"), text("start_date_month", "month"), text("start_date_dayofweek", "weekday"),
        text("PLATE_NO", "plate"), text("plates", "plates"), text("status", "status"),
    )


@query(
    f"""WITH {_FLAT} SELECT 'cam' || CAST(user_id % 7 AS VARCHAR) AS camera, label, strftime(ts, '%Y-%m-%d') AS day,
    strftime(ts, '%a') AS weekday, count(*) AS events FROM e WHERE NOT bad GROUP BY ALL"""
)
def calendar_counts(t: Tables) -> DataFrame:
    flat = c.events_media(c.valid_messages(messages(t)), recognition(t))
    counts = c.calendar_counts(flat, ["camera", "label"])
    return counts.select(
        "camera", "label", F.col("start_date_date").cast("string").alias("day"), F.col("start_date_dayofweek").alias("weekday"), "events"
    )


@query("SELECT event_id AS id FROM events WHERE event_type <> 'error'")
def valid_messages(t: Tables) -> DataFrame:
    return c.valid_messages(messages(t)).select("id")


@query(f"WITH {_FLAT} SELECT event_id AS id FROM e WHERE NOT bad AND label IN ('car', 'dog') AND has_after AND value > 20")
def wanted_messages(t: Tables) -> DataFrame:
    return c.wanted_messages(messages(t), ["car", "dog"]).select("id")


@query(
    f"""WITH {_FLAT} SELECT event_id AS id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS start_time,
    CASE WHEN event_type = 'purchase' THEN strftime(date_trunc('second', ts) + INTERVAL 30 SECOND, '%Y-%m-%d %H:%M:%S') ELSE 'unknown' END AS end_time,
    'cam' || CAST(user_id % 7 AS VARCHAR) AS camera, label AS labels, 'before-ev' || event_id AS clip_id, 'none' AS thumb FROM e WHERE NOT bad"""
)
def event_summaries(t: Tables) -> DataFrame:
    return c.event_summary(c.valid_messages(messages(t)).select("id", "data"))


@query("SELECT min(event_id) AS id, sha256(props) AS data_hash, '2024-02-01' AS created_at FROM events GROUP BY props")
def ingested_events(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("event_id").alias("id"), F.col("props").alias("data"))
    return c.ingest_events(rows, F.lit("2024-02-01")).select("id", "data_hash", "created_at")


@query("SELECT event_id, 'PENDING' AS status FROM events")
def pending_recognition(t: Tables) -> DataFrame:
    return c.add_recognition(t.events.select(F.col("event_id").alias("id"))).select("event_id", "status")
