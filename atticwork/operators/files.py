"""File catalogues: media lists, hashes, sidecars, work queues, month folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from .dedup import first_per_key

# Extensions of images and videos, of images with sidecars, and EXIF date tags.
IMAGES = ["jpg", "jpeg", "png", "bmp", "gif", "tiff", "tif", "webp", "heic", "heif", "svg"]
VIDEOS = ["mp4", "avi", "mov", "mkv", "wmv", "flv", "webm", "mpg", "mpeg", "3gp", "mts", "m2ts", "ts", "vob", "m4v"]
SIDECAR_IMAGES = ["jpg", "jpeg", "png", "bmp", "tif", "tiff", "gif", "webp", "cr2"]
EXIF_DATES = [
    "DateTimeOriginal", "DateTime", "DateTimeDigitized", "CreateDate", "ModifyDate", "DateCreated", "TimeCreated",
]
PHOTO_TAKEN_AFTER = 930063138


def has_extension(path: Column | str, extensions: list[str]) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1)).isin(extensions)


def is_hidden(path: Column | str, root: str = "") -> Column:
    """Below ``root``, the file or a folder on the way to it starts with a dot."""
    below = F.regexp_replace(path, F.lit("^" + "".join("\\" + c if not c.isalnum() else c for c in root)), F.lit(""))
    return below.rlike(r"(?:^|/)\.[^/]")


def select_media(
    files: DataFrame, extensions: list[str] | None = None, min_size: int = 0, max_size: int = 0,
    skip_hidden: bool = True, root: str = "",
) -> DataFrame:
    """Media files of a listing ``(path, size, mtime)`` within the size bounds; 0 means no bound."""
    out = files.filter(has_extension("path", extensions or IMAGES + VIDEOS))
    if min_size > 0:
        out = out.filter(F.col("size") >= min_size)
    if max_size > 0:
        out = out.filter(F.col("size") <= max_size)
    return out.filter(~is_hidden("path", root)) if skip_hidden else out


def content_hash(content: Column | str, prefix_bytes: int | None = None) -> Column:
    """md5 of the content, or of its first bytes only (files that differ later then look equal)."""
    if prefix_bytes is None:
        return F.md5(content)
    return F.md5(F.substring(content, 1, prefix_bytes))


def hash_with_cache(listing: DataFrame, contents: DataFrame, cache: DataFrame, alg: str = "md5") -> DataFrame:
    """Hash table for a listing, reusing rows of the cache whose path, size, time and algorithm agree.

    Only missing files are joined with ``contents(path, content)``. The result is the new version of the
    cache restricted to the listing.
    """
    key = ["path", "size", "mtime"]
    known = cache.filter((F.col("hash_alg") == alg) & F.col("hash").isNotNull()).select(*key, "hash")
    hits = listing.select(*key).join(known, key)
    misses = listing.select(*key).join(known, key, "left_anti")
    fresh = misses.join(contents.select("path", content_hash("content").alias("hash")), "path")
    return hits.unionByName(fresh.select(*key, "hash")).withColumn("hash_alg", F.lit(alg))


def upsert_cache(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Union of old and new rows, the new one winning per path."""
    both = fresh.withColumn("_old", F.lit(0)).unionByName(cache.select(*fresh.columns).withColumn("_old", F.lit(1)))
    return first_per_key(both, ["path"], ["_old"]).drop("_old")


def has_rich_exif(exif: Column | str) -> Column:
    """A tag map with a date tag and a tag that is not a date."""
    keys = F.map_keys(exif)
    return F.coalesce(
        F.exists(keys, lambda k: k.isin(EXIF_DATES)) & F.exists(keys, lambda k: ~k.isin(EXIF_DATES)), F.lit(False)
    )


def attach_sidecar(media: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Media with the row of their ``<path>.json``."""
    side = sidecars.withColumnRenamed("path", "sidecar_path")
    return media.withColumn("sidecar_path", F.concat("path", F.lit(".json"))).join(side, "sidecar_path")


def best_timestamp(taken: Column | str, created: Column | str) -> Column:
    """Photo-taken epoch seconds if after mid 1999, else the creation time."""
    taken, created = (F.col(c) if isinstance(c, str) else c for c in (taken, created))
    return F.when(taken > PHOTO_TAKEN_AFTER, taken).otherwise(created)


def time_label(original: Column | str, mtime: Column | str) -> Column:
    """Label for a file name: EXIF original date, else modification time."""
    shot = F.try_to_timestamp(F.col(original) if isinstance(original, str) else original, F.lit("yyyy:MM:dd HH:mm:ss"))
    return F.date_format(F.coalesce(shot, mtime), "yyyy-MM-dd_HH-mm-ss")


def transcription_status(media: DataFrame, outputs: DataFrame) -> DataFrame:
    """Media with SUCCESS (a non-empty transcript), FAILED (only empty ones) or NOT_ATTEMPTED.

    ``media(dir, name, …)``, ``outputs(dir, name, size)``. A transcript is named ``<stem>.….txt``. Every
    dot-terminated prefix of its name is a stem it may belong to, which turns the prefix test into an
    equality join.
    """
    dots = F.sequence(F.lit(1), F.size("_bits") - 1)
    stems = F.transform(dots, lambda n: F.array_join(F.slice("_bits", 1, n), "."))
    written = (
        outputs.filter(F.col("name").endswith(".txt") & F.contains("name", F.lit(".")))
        .withColumn("_bits", F.split("name", r"\."))
        .select("dir", F.explode(stems).alias("stem"), "size")
        .groupBy("dir", "stem")
        .agg(F.max("size").alias("_largest"))
    )
    stem = F.when(F.col("name").rlike(r"^.+\.[^.]+$"), F.regexp_replace("name", r"\.[^.]*$", "")).otherwise(F.col("name"))
    return (
        media.withColumn("stem", stem)
        .join(written, ["dir", "stem"], "left")
        .withColumn(
            "status",
            F.when(F.col("_largest") > 0, "SUCCESS").when(F.col("_largest") == 0, "FAILED").otherwise("NOT_ATTEMPTED"),
        )
        .drop("_largest", "stem")
    )


def work_queue(status: DataFrame, skip_existing: bool = True) -> DataFrame:
    """What is to be worked on, newest first."""
    todo = status.filter("status <> 'SUCCESS'") if skip_existing else status
    return todo.orderBy(F.desc("mtime"), "dir", "name")


def queue_stats(status: DataFrame) -> DataFrame:
    return status.agg(
        F.count(F.lit(1)).alias("found"),
        F.count_if(F.col("status") == "SUCCESS").alias("skipped"),
        F.count_if(F.col("status") != "SUCCESS").alias("waiting"),
        F.count_if(F.col("status") == "FAILED").alias("failed"),
    )


def with_month(files: DataFrame, name: str = "name", this_year: Column | None = None) -> DataFrame:
    """Files whose name carries a date, with their month ``ym``."""
    year = F.year(F.current_date()) if this_year is None else this_year
    return files.withColumn("ym", t.file_month(name, year)).filter("ym is not null")


def write_by_month(files: DataFrame, path: str, **kw) -> None:
    with_month(files, **kw).write.mode("append").partitionBy("ym").parquet(path)
