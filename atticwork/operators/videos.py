"""Video files, face tracks, track segments and the local persons found in them.

``videos(id, filename, start_time, …)``, ``tracks(id, video_id, local_person_id, best_quality,
best_frame_index)``, ``segments(id, face_track_id, quality, frame_index)``, ``persons(id, label,
known_name, track_count)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from .ordered import in_parts, ranked
from .paging import top_per_key

VIDEO_SORT = {
    "date_desc": [F.desc, "start_time"],
    "date_asc": [F.asc, "start_time"],
    "name_asc": [F.asc, "filename"],
    "name_desc": [F.desc, "filename"],
    "persons_desc": [F.desc, "person_count"],
    "persons_asc": [F.asc, "person_count"],
}

PERSON_SORT = {
    "tracks_desc": [F.desc, "track_count"],
    "tracks_asc": [F.asc, "track_count"],
    "days_desc": [F.desc, "distinct_days"],
    "days_asc": [F.asc, "distinct_days"],
    "name_asc": [F.asc, "shown_name"],
    "name_desc": [F.desc, "shown_name"],
}


def video_order(sort: str) -> list:
    """Sort columns of a video list; unknown names mean newest first, ties by newest, then id."""
    direction, column = VIDEO_SORT.get(sort, VIDEO_SORT["date_desc"])
    return [direction(column), *([F.desc("start_time")] if column == "person_count" else []), F.col("id")]


def person_order(sort: str) -> list:
    direction, column = PERSON_SORT.get(sort, PERSON_SORT["tracks_desc"])
    lead = F.coalesce("known_name", "label") if column == "shown_name" else F.col(column)
    first = lead.desc() if direction is F.desc else lead.asc()
    return [first, *([F.desc("track_count")] if column == "distinct_days" else []), F.col("id")]


def letters(videos: DataFrame) -> DataFrame:
    return videos.select(F.upper(F.left("filename", F.lit(1))).alias("letter")).distinct().orderBy("letter")


def filter_videos(videos: DataFrame, q: str | None = None, letter: str | None = None) -> DataFrame:
    if q:
        videos = videos.filter(t.contains_ci("filename", q))
    if letter:
        videos = videos.filter(F.upper(F.left("filename", F.lit(1))) == letter.upper()[:1])
    return videos


def video_catalog(videos: DataFrame, tracks: DataFrame) -> DataFrame:
    """Videos with the number of distinct persons and of tracks."""
    per_video = tracks.groupBy(F.col("video_id").alias("id")).agg(
        F.count_distinct("local_person_id").alias("person_count"), F.count("id").alias("track_count")
    )
    zero = F.lit(0).cast("long")
    return (
        videos.join(per_video, "id", "left")
        .withColumn("person_count", F.coalesce("person_count", zero))
        .withColumn("track_count", F.coalesce("track_count", zero))
    )


def track_faces(tracks: DataFrame, segments: DataFrame) -> DataFrame:
    """One row per segment; a track without segments gives one row with its own best face."""
    parts = segments.select(
        F.col("id").alias("segment_id"), F.col("face_track_id").alias("track_id"), "quality", "frame_index"
    )
    return (
        tracks.withColumnRenamed("id", "track_id").join(parts, "track_id", "left")
        .withColumn("quality", F.coalesce("quality", "best_quality"))
        .withColumn("frame_index", F.coalesce("frame_index", "best_frame_index"))
        .select("video_id", "local_person_id", "track_id", "segment_id", "quality", "frame_index")
    )


def video_persons(tracks: DataFrame, segments: DataFrame, persons: DataFrame) -> DataFrame:
    """Persons of each video with segment count, best quality and place in the list (``rank``): most
    segments first, then best quality, none last, then by id."""
    per_pair = track_faces(tracks, segments).groupBy("video_id", "local_person_id").agg(
        F.count("segment_id").alias("segment_count"), F.max("quality").alias("best_quality")
    )
    names = persons.select(F.col("id").alias("local_person_id"), "label", "known_name")
    placed = per_pair.withColumns({"_a": -F.col("segment_count"), "_b": F.col("best_quality").isNull(), "_c": -F.col("best_quality")})
    placed = ranked(placed, ["video_id"], ["_a", "_b", "_c", "local_person_id"], "rank").drop("_a", "_b", "_c")
    return placed.join(names, "local_person_id", "left")


def video_segments(tracks: DataFrame, segments: DataFrame) -> DataFrame:
    """Faces of a person in a video as JSON, by frame with missing frames last, in bounded parts."""
    faces = track_faces(tracks, segments).withColumn("no_frame", F.col("frame_index").isNull())
    item = F.struct("segment_id", "track_id", "quality", "frame_index")
    order = ["no_frame", "frame_index", "track_id", "segment_id"]
    parts = in_parts(faces, ["video_id", "local_person_id"], order, item, "items")
    return parts.select("video_id", "local_person_id", "part", F.to_json("items", {"ignoreNullFields": "false"}).alias("segments"))


def person_days(tracks: DataFrame, videos: DataFrame) -> DataFrame:
    """On how many different days a person was seen.

    (person, day) pairs are made distinct with map-side combine first; a person seen everywhere then
    has at most one row per day left to count.
    """
    when = videos.select(F.col("id").alias("video_id"), F.to_date("start_time").alias("day"))
    days = tracks.select("local_person_id", "video_id").distinct().join(when, "video_id")
    pairs = days.filter("day is not null").select("local_person_id", "day").distinct()
    return pairs.groupBy("local_person_id").agg(F.count(F.lit(1)).alias("distinct_days"))


def local_persons(persons: DataFrame, tracks: DataFrame, videos: DataFrame, min_days: int = 1, q: str | None = None) -> DataFrame:
    """Persons with days seen and their best track."""
    best = (
        tracks.groupBy(F.col("local_person_id").alias("id"))
        .agg(F.min(F.struct((-F.col("best_quality")).alias("q"), "id")).alias("b"))
        .select("id", F.col("b.id").alias("best_track_id"))
    )
    days = person_days(tracks, videos).withColumnRenamed("local_person_id", "id")
    if q:
        persons = persons.filter(t.contains_ci("label", q) | t.contains_ci("known_name", q))
    out = (
        persons.join(days, "id", "left").join(best, "id", "left")
        .withColumn("distinct_days", F.coalesce("distinct_days", F.lit(0)))
    )
    return out.filter(F.col("distinct_days") >= min_days) if min_days > 1 else out


def person_files(tracks: DataFrame, videos: DataFrame) -> DataFrame:
    """Files a person was seen in, with the tracks there as JSON by quality, in bounded parts."""
    own = tracks.withColumn("_worse", -F.col("best_quality"))
    item = F.struct(F.col("id").alias("track_id"), "best_quality")
    parts = in_parts(own, ["local_person_id", "video_id"], ["_worse", "id"], item, "items")
    files = videos.select(F.col("id").alias("video_id"), "filename", "start_time")
    return parts.join(files, "video_id").select(
        "local_person_id", "video_id", "filename", "start_time", "part", F.to_json("items", {"ignoreNullFields": "false"}).alias("tracks")
    )


def best_faces(segments: DataFrame, tracks: DataFrame, videos: DataFrame, n: int = 16) -> DataFrame:
    """The ``n`` best segment faces of each person; persons without any segment get their best tracks."""
    owner = tracks.select(F.col("id").alias("face_track_id"), "local_person_id", "video_id")
    seg = segments.select(
        F.col("id").alias("segment_id"), "face_track_id", F.col("quality").cast("double").alias("quality")
    ).join(owner, "face_track_id")
    with_segments = seg.select("local_person_id").distinct()
    whole = tracks.join(with_segments, "local_person_id", "left_anti").select(
        F.lit(None).cast(segments.schema["id"].dataType).alias("segment_id"),
        F.col("id").alias("face_track_id"),
        F.col("best_quality").cast("double").alias("quality"),
        "local_person_id",
        "video_id",
    )
    order = [F.desc_nulls_last("quality"), F.col("face_track_id"), F.col("segment_id")]
    best = top_per_key(seg.unionByName(whole), ["local_person_id"], order, n)
    return best.join(videos.select(F.col("id").alias("video_id"), "filename"), "video_id")


def delete_video(tables: dict[str, DataFrame], video_id: int) -> dict[str, DataFrame]:
    """New versions of videos, tracks, segments and facts without one video and what hangs on it."""
    gone = tables["tracks"].filter(F.col("video_id") == video_id).select(F.col("id").alias("face_track_id"))
    return {
        "videos": tables["videos"].filter(F.col("id") != video_id),
        "tracks": tables["tracks"].filter(F.col("video_id").isNull() | (F.col("video_id") != video_id)),
        "segments": tables["segments"].join(gone, "face_track_id", "left_anti"),
        "facts": tables["facts"].join(gone, "face_track_id", "left_anti"),
    }
