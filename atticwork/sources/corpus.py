"""Markdown corpus scan and the chunk table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators.chunking import chunk_markdown, valid_chunks
from ..operators.nearest import embed
from ..operators.search import stored_chunks
from ..operators.sections import build_section_index

# Fixed value: tasks of a file scan that are joined to one.
JOINED_TASKS = 8


def read_corpus(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """One row per document below ``path``: ``doc`` (path), ``source`` (file name), ``text``.

    Unreadable files are skipped; bytes that are not UTF-8 become replacement characters.

    Spark reads 32 small files in a task, and starting one takes longer than cutting them up: some tasks are joined. They
    still read file by file.
    """
    read = (
        spark.read.option("ignoreCorruptFiles", True)
        .text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
        .select(F.col("_metadata.file_path").alias("doc"), F.col("_metadata.file_name").alias("source"), F.make_valid_utf8("value").alias("text"))
    )
    return read.coalesce(max(4 * spark.sparkContext.defaultParallelism, read.rdd.getNumPartitions() // JOINED_TASKS))


def with_row_id(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("id", F.expr("uuid()"))


def write_chunks(chunks: DataFrame, table: str) -> None:
    """Append chunks with new row ids."""
    with_row_id(chunks).write.mode("append").saveAsTable(table)


def reindex(
    spark: SparkSession, corpus: DataFrame, table: str, embed_fn: Callable[[list[str]], list[list[float]]], section_vector,
    size: int = 1500, overlap: int = 300,
) -> None:
    """Rebuild the chunk table and its section-name index from a corpus.

    Chunks are made distinct and embedded once, at write time. They are laid out by source and line
    before the embedding step, so that a source filter skips row groups later and nothing after the
    expensive step needs a shuffle. ``section_vector`` maps the section text Column to its vector Column.
    """
    chunks = stored_chunks(valid_chunks(chunk_markdown(corpus, size, overlap)))
    laid_out = chunks.repartitionByRange("source", "line_start").sortWithinPartitions("source", "line_start")
    embedded = embed(laid_out.withColumn("_text", t.embedding_text("content")), "_text", embed_fn).drop("_text")
    with_row_id(embedded).write.mode("overwrite").saveAsTable(table)
    build_section_index(spark.table(table), section_vector).write.mode("overwrite").saveAsTable(f"{table}_sections")


def drop_chunks(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(f"DROP TABLE IF EXISTS {table}_sections")
