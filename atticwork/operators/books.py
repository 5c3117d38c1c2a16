"""Book sections and sentence packing."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from .ordered import ranked

# Fixed values.
PACK_MIN, PACK_MAX, PACK_OVERLAP = 700, 1500, 200
MAX_SECTION = 100_000
MIN_SINGLE, MIN_BATCH = 1000, 5000
PART_WORD = "часть"
#: Paragraphs of a text that are folded at once.
FOLDED = 1024


def pack_text(sentences: list[str], smallest: int, largest: int, overlap: int) -> list[tuple[str, int, int]]:
    """Runs of whole sentences as (text, start, end), places in the text of all sentences joined by blanks.

    A run has as many sentences as fit into ``largest`` characters, one at least. The next run starts with the whole
    sentences at its end that reach ``overlap`` characters, fewer if the next sentence would not fit behind them.
    A run shorter than ``smallest`` is joined to the one before.
    """
    begins = [0, *accumulate(len(sentence) + 1 for sentence in sentences)]
    runs: list[tuple[int, int]] = []
    first = 0
    while first < len(sentences):
        stop = max(first + 1, bisect_right(begins, begins[first] + largest + 1) - 1)
        if runs and begins[stop] - 1 - begins[first] < smallest:
            runs[-1] = (runs[-1][0], stop)
        else:
            runs.append((first, stop))
        if stop == len(sentences):
            break
        reach = bisect_right(begins, begins[stop] - overlap) - 1
        fits = bisect_left(begins, begins[stop + 1] - 1 - largest)
        first = min(stop, max(first + 1, reach, fits))
    return [(" ".join(sentences[a:b]), begins[a], begins[b] - 1) for a, b in runs]


def pack_sentences(
    df: DataFrame, text: str, smallest: int = PACK_MIN, largest: int = PACK_MAX, overlap: int = PACK_OVERLAP
) -> DataFrame:
    """Add one row per packed chunk: ``chunk_no``, ``chunk_text``, ``start_pos``, ``end_pos``.

    Sentences are split by Spark; only the ordered packing of one text runs in Python."""

    @F.pandas_udf("array<struct<text:string,start:int,end:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            packed = [pack_text(list(s), smallest, largest, overlap) for s in batch]
            yield pd.Series([[dict(zip(("text", "start", "end"), c)) for c in p] for p in packed], dtype=object)

    tidy = t.strip(F.regexp_replace(text, "\n{3,}", "\n\n"))
    packed = run(F.coalesce(t.sentences(tidy), F.array().cast("array<string>")))
    return df.select("*", F.posexplode(packed).alias("chunk_no", "_c")).select(
        *df.columns, "chunk_no",
        F.col("_c.text").alias("chunk_text"), F.col("_c.start").alias("start_pos"), F.col("_c.end").alias("end_pos"),
    )


def split_long_section(df: DataFrame, title: str, content: str, max_size: int = MAX_SECTION) -> DataFrame:
    """Sections above ``max_size`` characters cut at blank lines into about equal parts with numbered
    titles; others pass unchanged. Adds ``part_no``, ``part_title``, ``part_content``.

    A fold over the paragraph array keeps only sizes and places; the texts are sliced afterwards. Each step of a fold copies
    its state, so the paragraphs are taken in blocks: the list of all cuts is copied once a block only.
    """
    size = F.length(content)
    # An empty text is one part too.
    target = F.floor(size / F.greatest(F.ceil(size / max_size), F.lit(1))).cast("int")
    none = F.array().cast("array<int>")

    def state(held: Column, index: Column, first: Column, cuts: Column) -> Column:
        return F.struct(held.alias("held"), index.alias("i"), first.alias("first"), cuts.alias("cuts"))

    def step(acc: Column, p: Column) -> Column:
        length, index = F.length(p), acc["i"]
        full = (acc["held"] + length + 2 > F.col("_target")) & (index > acc["first"])
        return F.when(full, state(length, index + 1, index, F.concat(acc["cuts"], F.array(index)))).otherwise(
            state(acc["held"] + length + 2, index + 1, acc["first"], acc["cuts"])
        )

    def block(acc: Column, at: Column) -> Column:
        fresh = state(acc["held"], acc["i"], acc["first"], none)
        return F.aggregate(F.slice("_paragraphs", at + 1, FOLDED), fresh, step, lambda new: state(new["held"], new["i"], new["first"], F.concat(acc["cuts"], new["cuts"])))

    blocks = F.sequence(F.lit(0), F.size("_paragraphs") - 1, F.lit(FOLDED))
    start = state(F.lit(0), F.lit(0), F.lit(0), F.array(F.lit(0)))
    texts = F.transform(
        "_cuts",
        lambda at, k: F.array_join(
            F.slice("_paragraphs", at + 1, F.coalesce(F.get("_cuts", k + 1), F.size("_paragraphs")) - at), "\n\n"
        ),
    )
    # Paragraphs and cuts are columns of their own so that no lambda splits the text again.
    long = df.withColumn("_long", size > max_size).withColumn(
        "_paragraphs", F.when(F.col("_long"), F.split(content, "\n\n")).otherwise(F.array(F.col(content)))
    )
    cuts = F.aggregate(blocks, start, block)["cuts"]
    long = long.withColumn("_target", target).withColumn("_cuts", cuts)
    return (
        long.select("*", F.posexplode(texts).alias("part_no", "part_content"))
        .withColumn(
            "part_title",
            F.when(
                F.col("_long"), F.concat(F.col(title), F.lit(f" - {PART_WORD} "), (F.col("part_no") + 1).cast("string"))
            ).otherwise(F.col(title)),
        )
        .drop("_long", "_paragraphs", "_target", "_cuts")
    )


def flatten_sections(tree: DataFrame) -> DataFrame:
    """Leaf sections of a nested book.

    ``tree(book, sections)`` where a section is ``struct(title, p: array<string>, section: array<…>)``, nested as
    deep as the schema is. A leaf's title is its path joined by `` - ``; parts without a title do not
    show. Sections without text of their own are left out.
    """
    none = F.array().cast("array<string>")

    def leaves(section: Column, kind: T.StructType, path: Column, above: Column) -> Column:
        fields = kind.fieldNames()
        title = t.strip(F.coalesce(section["title"], F.lit(""))) if "title" in fields else F.lit("")
        titles = F.concat(above, F.when(title != "", F.array(title)).otherwise(none))
        own = F.array_join(F.filter(F.transform(section["p"], t.strip), lambda p: p != ""), "\n") if "p" in fields else F.lit("")
        leaf = F.array(F.struct(path.alias("path"), F.array_join(titles, " - ").alias("title"), F.coalesce(own, F.lit("")).alias("content")))
        if "section" not in fields:
            return leaf
        inner = kind["section"].dataType.elementType
        deeper = F.flatten(F.transform(section["section"], lambda s, i: leaves(s, inner, _placed(path, i), titles)))
        return F.when(F.coalesce(F.size(section["section"]) > 0, F.lit(False)), deeper).otherwise(leaf)

    # All leaves of a book are made in its row, in one pass: the text is read and cut up once, however deep it is.
    kind = tree.schema["sections"].dataType.elementType
    all_ = F.flatten(F.transform("sections", lambda s, i: leaves(s, kind, _placed(F.lit(""), i), none)))
    return tree.select("book", F.explode(all_).alias("_leaf")).select("book", "_leaf.path", "_leaf.title", "_leaf.content").filter("content <> ''")


def _placed(path: Column, i: Column) -> Column:
    """Zero-padded positions put siblings in reading order when compared as text."""
    return F.concat(path, F.format_string("%08d.", i))


def number_sections(sections: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Continue the numbering of a book with its new sections.

    ``sections(book, path, title, content)``, ``existing(book, idx, title)``. Titles already present and
    second uses of a title are skipped and take no number; untitled sections are always kept. The
    sections of a book come from one file, that is one row, so a plain window is bounded.
    """
    # Rows are dealt by book once, for both windows. Of sections at equal places the least is kept.
    rest = [c for c in sections.columns if c not in ("book", "title", "path")]
    use = F.row_number().over(W.partitionBy("book", "title").orderBy("path", *rest))
    dealt = sections.filter("title IS NOT NULL").repartition("book")
    fresh = dealt.withColumn("_use", use).filter("title = '' OR _use = 1").drop("_use")
    number = F.row_number().over(W.partitionBy("book").orderBy("path"))
    if existing is not None:
        fresh = fresh.join(existing.select("book", "title").distinct(), ["book", "title"], "left_anti")
        top = existing.groupBy("book").agg(F.max("idx").alias("_top"))
        numbered = fresh.withColumn("_n", number).join(top, "book", "left")
        idx = F.coalesce(F.col("_top"), F.lit(-1)) + F.col("_n")
    else:
        numbered = fresh.withColumn("_n", number)
        idx = F.col("_n") - 1
    return numbered.withColumn("idx", idx.cast("long")).withColumn(
        "file_name", t.numbered_file_title(F.col("title"), idx.cast("int"))
    ).drop("_n", "_top", "path")


def continue_index(new: DataFrame, existing: DataFrame, keys: list[str], order: list[str], idx: str = "idx") -> DataFrame:
    """Number new rows per key after the largest number in use (from 0 where there is none)."""
    top = existing.groupBy(*keys).agg(F.max(idx).alias("_top"))
    return (
        ranked(new, keys, order, "_n")
        .join(top, keys, "left")
        .withColumn(idx, (F.coalesce("_top", F.lit(-1)) + F.col("_n")).cast("long"))
        .drop("_n", "_top")
    )


def body_text(content: Column | str) -> Column:
    """Section text without a ``=== title ===`` first line and the line after it."""
    return F.regexp_replace(content, r"^===[^\n]*===(?:\n[^\n]*)?(?:\n|$)", "")


def summary_queue(
    sections: DataFrame, summaries: DataFrame, keys: list[str], min_size: int = MIN_BATCH, max_chars: int | None = None
) -> DataFrame:
    """Sections that still need a summary: long enough and without one. ``prompt_text`` is the whole body, or with
    ``max_chars`` its start; longer sections can be cut into parts by ``split_long_section`` before."""
    body = body_text("content")
    waiting = sections.withColumn("body", body).filter(F.length(t.strip("body")) >= min_size)
    return waiting.join(summaries.select(*keys), keys, "left_anti").withColumn(
        "prompt_text", F.col("body") if max_chars is None else F.left("body", F.lit(max_chars))
    )


def run_summary(results: DataFrame) -> DataFrame:
    """Totals of a batch run. The mean divides the whole time by all runs, failed ones included."""
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("success").alias("ok"),
        F.count_if(~F.col("success")).alias("failed"),
        F.sum("duration").alias("total_time"),
        F.avg("duration").alias("avg_time"),
    )


def failed_runs(results: DataFrame) -> DataFrame:
    return results.filter(~F.col("success")).select("model", "error")
