"""Camera events: ingest, flattening, label and video filters, calendar counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import payload as pl
from .dedup import first_per_key

_SIDE = "id string, camera string, label string, has_clip string, has_snapshot string, start_time string, end_time string"
PAYLOAD_SCHEMA = f"type string, before struct<{_SIDE}>, after struct<{_SIDE}>"


def valid_messages(df: DataFrame, payload: str = "data") -> DataFrame:
    """Empty and non-JSON payloads are dropped."""
    return df.filter(F.trim(payload) != "").filter(F.expr(f"try_parse_json({payload}) is not null"))


def ingest_events(df: DataFrame, now: Column, payload: str = "data", order: list[str] | None = None) -> DataFrame:
    """Events with ``data_hash`` and ``created_at`` filled, one row per hash."""
    hashed = df.withColumn("data_hash", F.sha2(payload, 256))
    hashed = hashed.withColumn("created_at", F.coalesce("created_at", now) if "created_at" in df.columns else now)
    return first_per_key(hashed, ["data_hash"], order or ["id"])


def add_recognition(ids: DataFrame) -> DataFrame:
    """New rows of the recognition table, waiting to be worked on."""
    return ids.select(
        F.col("id").alias("event_id"), F.lit("PENDING").alias("status"), F.lit(None).cast("string").alias("result")
    )


def events_media(events: DataFrame, recognition: DataFrame, port: int = 5000) -> DataFrame:
    """Nested events as flat rows, joined with what was recognised.

    Every field is taken from ``after`` and, when missing or null there, from ``before``; the thumbnail
    link uses ``after`` only. The payload is parsed once per row with a fixed schema, all values read as
    text first because senders mix types.
    """
    parsed = events.withColumn("_p", F.from_json("data", PAYLOAD_SCHEMA))

    def pick(field: str) -> Column:
        return F.coalesce(F.col(f"_p.after.{field}"), F.col(f"_p.before.{field}"))

    def flag(field: str) -> Column:
        return pick(field).try_cast("boolean")

    def moment(field: str) -> Column:
        return F.timestamp_seconds(pick(field).try_cast("double"))

    def link(id_: Column, file: str) -> Column:
        return F.concat(F.lit("http://"), F.col("source"), F.lit(f":{port}/api/events/"), id_, F.lit(f"/{file}"))

    result = F.from_json("result", "adjusted string, detected string, message string, plates array<string>")
    read = recognition.select(F.col("event_id").alias("_eid"), "status", result.alias("_r"))
    start = F.col("start_time")
    return (
        parsed.join(read, F.col("id") == F.col("_eid"), "left")
        .select(
            "id",
            F.col("_p.type").alias("type"),
            pick("camera").alias("camera"),
            pick("label").alias("label"),
            pick("id").alias("event_id"),
            "source",
            flag("has_clip").alias("has_clip"),
            F.concat_ws(
                ", ",
                F.when(flag("has_clip"), link(pick("id"), "clip.mp4")),
                F.when(flag("has_snapshot"), link(pick("id"), "snapshot.jpg")),
            ).alias("media"),
            link(F.col("_p.after.id"), "thumbnail.jpg").alias("thumbnail_url"),
            moment("start_time").alias("start_time"),
            moment("end_time").alias("end_time"),
            F.col("_r.adjusted").alias("PLATE_NO"),
            F.col("_r.detected").alias("PLATE_NO_DET"),
            F.col("_r.message").alias("MESSAGE"),
            F.array_join("_r.plates", ", ").alias("plates"),
            "status",
            *(["created_at"] if "created_at" in events.columns else []),
        )
        .withColumn("start_date_date", F.to_date(start))
        .withColumn("start_date_month", F.date_format(start, "yyyy-MM"))
        .withColumn("start_date_dayofweek", F.date_format(start, "E"))
    )


def calendar_counts(media: DataFrame, keys: list[str]) -> DataFrame:
    """Events per key, day, month and weekday."""
    return media.groupBy(*keys, "start_date_date", "start_date_month", "start_date_dayofweek").agg(
        F.count(F.lit(1)).alias("events")
    )


def wanted_messages(df: DataFrame, labels: list[str], payload: str = "data") -> DataFrame:
    """Valid messages that name one of the labels and have video."""
    return valid_messages(df, payload).filter(pl.has_token(payload, labels)).filter(pl.has_video(payload))


def event_summary(df: DataFrame, payload: str = "data") -> DataFrame:
    """Camera, times, thumbnail, id and labels of a message, wherever in it they are."""

    def at(name: str) -> Column:
        value = pl.first_scalar(payload, name, skip_null=name == "end_time")
        shown = F.date_format(F.timestamp_seconds(value.try_cast("double")), "yyyy-MM-dd HH:mm:ss")
        return F.coalesce(shown, value, F.lit("unknown"))

    labels = F.array_distinct(F.concat(pl.array_strings(payload, "objects"), pl.all_strings(payload, "label")))
    return df.select(
        *[c for c in df.columns if c != payload],
        at("start_time").alias("start_time"),
        at("end_time").alias("end_time"),
        F.coalesce(pl.first_scalar(payload, "camera"), F.lit("unknown")).alias("camera"),
        F.array_join(labels, ", ").alias("labels"),
        F.coalesce(pl.first_scalar(payload, "id"), F.lit("none")).alias("clip_id"),
        F.coalesce(pl.first_string(payload, "thumb_path"), pl.first_string(payload, "thumb"), F.lit("none")).alias("thumb"),
    )
