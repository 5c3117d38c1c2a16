"""Books as XML: one row per book, with its sections as nested as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.statements import from_windows_1251

TAG = r"<[^<>]*>"


def _section_type(depth: int) -> str:
    """Sections ``depth`` levels deep; what lies deeper stays as raw XML."""
    inner = "array<string>" if depth == 1 else f"array<{_section_type(depth - 1)}>"
    return f"struct<title: struct<p: array<string>>, p: array<string>, section: {inner}>"


def _plain(xml: Column) -> Column:
    return F.regexp_replace(xml, TAG, "")


def _titled(section: Column, depth: int) -> Column:
    """A section with its title as text and its paragraphs without marks, in the form of ``books.flatten_sections``."""
    title = F.array_join(F.transform(section["title"]["p"], _plain), " ")
    paragraphs = F.transform(section["p"], _plain)
    if depth == 1:
        deeper = F.transform(F.coalesce(section["section"], F.array().cast("array<string>")), lambda x: F.regexp_replace(x, TAG, "\n"))
        return F.struct(title.alias("title"), F.concat(F.coalesce(paragraphs, F.array().cast("array<string>")), deeper).alias("p"))
    nested = F.transform(section["section"], lambda s: _titled(s, depth - 1))
    return F.struct(title.alias("title"), paragraphs.alias("p"), nested.alias("section"))


def scan_books(spark: SparkSession, path: str, depth: int = 6, row_tag: str = "FictionBook", windows: bool = False) -> DataFrame:
    """``(file, book, sections)`` of XML books, many in a file or one: every ``row_tag`` element is a row.

    ``book`` is the title from the description. Sections nest ``depth`` levels deep; the text of deeper ones, which no
    usual book has, becomes paragraphs of the section at the last level. A book without sections has an empty list.

    The files are in UTF-8, or with ``windows`` in the Windows Cyrillic code page. They are read as text that the closing tag cuts into books, since that can be split: Spark's XML reader takes
    a file, or each line by itself, in one piece.
    """
    body = f"struct<section: array<{_section_type(depth)}>>"
    schema = f"description struct<`title-info`: struct<`book-title`: string>>, body array<{body}>"
    closing = f"</{row_tag}>"
    pieces = spark.read.option("lineSep", closing).text(path).select(F.input_file_name().alias("file"), "value")
    pieces = pieces.withColumn("value", from_windows_1251(F.col("value"))) if windows else pieces
    opened = F.regexp_instr("value", F.lit(rf"<{row_tag}[\s>]"))
    xml = F.concat(F.substr("value", opened), F.lit(closing))
    parsed = pieces.filter(opened > 0).select("file", F.from_xml(xml, schema).alias("x")).select("file", "x.*")
    sections = F.coalesce(F.get("body", F.lit(0))["section"], F.array().cast(f"array<{_section_type(depth)}>"))
    return parsed.select(
        "file",
        F.col("description.title-info.book-title").alias("book"),
        F.transform(sections, lambda s: _titled(s, depth)).alias("sections"),
    )
