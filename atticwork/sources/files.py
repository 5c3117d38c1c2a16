"""Listings of media files, their contents and their JSON sidecars."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.files import select_media

# Fixed value: Spark's name for a null key in a path.
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def list_media(spark: SparkSession, dirs: list[str], min_size: int = 0, max_size: int = 0) -> DataFrame:
    """Media files below the folders: ``path, size, mtime``. Contents are not read, as the column is
    pruned from the scan.

    Spark's file scan never shows names that start with a dot or an underscore, so hidden files are
    always skipped here. To have them, make the listing elsewhere and use ``select_media`` on it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(dirs)
    listed = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return select_media(listed, None, min_size, max_size, skip_hidden=False)


def read_contents(spark: SparkSession, dirs: list[str]) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(dirs)
    return files.select("path", "content")


def nested_timestamp(json: Column | str, name: str) -> Column:
    """``<name>.timestamp`` at any depth, as epoch seconds."""
    found = F.regexp_extract(json, rf'"{name}"\s*:\s*\{{[^{{}}]*?"timestamp"\s*:\s*"?(-?\d+)', 1)
    return F.when(found != "", found).try_cast("long")


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """JSON sidecars with creation and photo-taken time in epoch seconds, null where absent."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    return raw.select(
        F.col("_metadata.file_path").alias("path"),
        nested_timestamp("value", "creationTime").alias("created"),
        nested_timestamp("value", "photoTakenTime").alias("taken"),
    )


def write_small_files(rows: DataFrame, key: str, value: str, folder: str, extension: str) -> None:
    """A file ``<key>=<its value>.<extension>`` per key below the folder with the texts of its rows, each ended by a new line; a
    null text is an empty line. This is for very many keys, each with little text.

    The keys are dealt to all cores: left to itself Spark joins so little text in one task. On a disk that the machines
    share, each task writes the files of its keys into a folder of its own, since Spark starts two processes for each local
    file it makes and lists a folder per key; a task that is repeated writes the same files again. On other stores
    Spark's own writer makes a folder per key.
    """
    spark = rows.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.select(F.col(key), F.col(value).cast("string").alias("value")).repartition(tasks, key)
    if urlsplit(folder).scheme not in ("", "file"):
        dealt.write.option("lineSep", "\n").option("extension", extension).partitionBy(key).text(folder)
        return

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        own = f"{root}/files-{TaskContext.get().partitionId():05d}"
        store.create_dir(own)
        opened, out, files = None, None, 0
        try:
            for batch in batches:
                for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if out is None or name != opened:
                        if out is not None:
                            out.close()
                        file = f"{key}={NULL_FOLDER if name is None else quote(name, safe=' ')}.{extension}"
                        opened, out, files = name, store.open_output_stream(f"{own}/{file}"), files + 1
                    out.write((text or b"") + b"\n")
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    ordered = dealt.select(F.col(key).cast("string").alias("key"), F.col("value").cast("binary")).sortWithinPartitions("key", "value")
    ordered.mapInArrow(write, "files long").agg(F.sum("files")).collect()
    # An input without rows is a folder without files.
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root)
