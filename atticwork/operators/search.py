"""Search over the chunk table: substring, several terms, regular expression, neighbours, samples.

A chunk has ``source, section, chunk_type, table_headers, content, line_start, line_end, chunk_index``
and, for vector search only, ``embedding``; text searches never read that column. The default
``chunk_type=""`` means prose. Pass ``None`` for chunks of every type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t
from .dedup import first_of_equal, first_per_key
from .ordered import in_parts, ranked

PLACE = ["source", "line_start", "chunk_index", "section", "chunk_type"]
CHUNK_KEY = ["source", "section", "chunk_type", "chunk_index"]


def with_filters(
    df: DataFrame, chunk_type: str | None = None, source: str | None = None, section: str | None = None
) -> DataFrame:
    """The optional filters shared by all searches; equality ones reach the scan."""
    if chunk_type is not None:
        df = df.filter(F.col("chunk_type") == chunk_type)
    if source is not None:
        df = df.filter(F.col("source") == source)
    if section is not None:
        df = df.filter(t.contains_ci("section", section))
    return df


def stored_chunks(chunks: DataFrame) -> DataFrame:
    """One row per (source, section, chunk_type, content); of equal chunks the first in order stays.

    Line and index tell the chunks of a source, section and type apart."""
    return first_of_equal(chunks, ["source", "section", "chunk_type", "content"], ["line_start", "chunk_index"])


def count_chunks(chunks: DataFrame) -> DataFrame:
    """Number of stored chunks. Content takes part as a digest, so texts are not shuffled."""
    keys = chunks.select("source", "section", "chunk_type", F.sha2("content", 256).alias("digest"))
    return keys.distinct().agg(F.count(F.lit(1)).alias("chunks"))


def in_order(rows: DataFrame, order: list[Column | str], limit: int | None) -> DataFrame:
    """The rows sorted; with a limit the first ones, numbered as ``rank`` from 1."""
    if limit is None:
        return rows.orderBy(*order)
    top = rows.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).orderBy("rank")


def exact_search(
    chunks: DataFrame,
    query: str,
    limit: int | None = None,
    chunk_type: str | None = "",
    source: str | None = None,
    section: str | None = None,
) -> DataFrame:
    """Chunks whose content holds the text, any case, in reading order; a chunk listed once.

    All of them, or the first ``limit`` with their ``rank``."""
    hits = with_filters(chunks, chunk_type, source, section).filter(t.contains_ci("content", query))
    return in_order(first_per_key(hits, CHUNK_KEY, ["line_start"]), PLACE, limit)


def multi_term_search(
    chunks: DataFrame,
    terms: list[str],
    limit: int | None = None,
    chunk_type: str | None = "",
    source: str | None = None,
    section: str | None = None,
) -> DataFrame:
    """Chunks with at least one term, those with most terms first, as column ``match_count``."""
    unique = list(dict.fromkeys(terms))
    scored = (
        with_filters(chunks, chunk_type, source, section)
        .withColumn("match_count", t.match_count("content", unique))
        .filter("match_count > 0")
    )
    return in_order(first_per_key(scored, CHUNK_KEY, ["line_start"]), [F.desc("match_count"), *PLACE], limit)


def coverage_groups(hits: DataFrame) -> DataFrame:
    """All hits of a multi-term search counted by the number of matched terms, with ``total_chunks`` and
    ``max_coverage`` of the whole search. One row per number of terms, so the totals are a window over few rows."""
    counted = hits.groupBy("match_count").agg(F.count(F.lit(1)).alias("chunks"))
    whole = Window.partitionBy(F.lit(0))
    return counted.select(
        "match_count", "chunks", F.sum("chunks").over(whole).alias("total_chunks"), F.max("match_count").over(whole).alias("max_coverage")
    )


def regex_search(chunks: DataFrame, pattern: str, max_results: int | None = None) -> DataFrame:
    """Every match as a row (whole match, any case), in reading order; all of them, or the first ``max_results``.

    A matching chunk has one match at least, so the first ``max_results`` chunks hold the first matches."""
    folded = t.folded(pattern)
    rows = chunks.filter(F.col("content").rlike(folded))
    if max_results is not None:
        rows = rows.orderBy(*PLACE).limit(max_results)
    found = rows.select(
        *PLACE, F.posexplode(F.regexp_extract_all("content", F.lit(folded), 0)).alias("match_no", "matched_text")
    )
    ordered = found.orderBy(*PLACE, "match_no")
    return (ordered if max_results is None else ordered.limit(max_results)).select(
        "source", "line_start", "chunk_index", "match_no", "matched_text"
    )


def find_expansions(chunks: DataFrame, abbreviation: str, max_results: int | None = None) -> DataFrame:
    """What an abbreviation stands for, with the prose chunk nearest to its first mention, by expansion.

    All expansions, or the first ``max_results`` in alphabetical order. A prose chunk in the line of the mention that holds the
    expansion is the nearest by itself; only the other expansions are looked for in the whole source.
    """
    pattern = t.abbreviation_pattern(abbreviation)
    matches = (
        chunks.limit(0).select("source", "line_start", "chunk_index", F.lit(0).alias("match_no"), F.lit("").alias("matched_text"))
        if pattern is None
        else regex_search(chunks, pattern)
    )
    named = matches.withColumn("expansion", F.regexp_replace(t.strip("matched_text"), r"(?U)\s+", " "))
    mentions = (
        named.filter("expansion <> ''")
        .groupBy("expansion")
        .agg(F.min(F.struct("source", "line_start", "chunk_index", "match_no")).alias("at"))
        .select("expansion", F.col("at.source").alias("source"), F.col("at.line_start").alias("mention_line"))
    )
    if max_results is not None:
        mentions = mentions.orderBy("expansion").limit(max_results)
    prose = chunks.filter("chunk_type = ''").select("source", "section", "content", "line_start", "chunk_index")
    holds = F.contains(F.lower("content"), F.lower("expansion"))

    def nearest(near: DataFrame) -> DataFrame:
        gap = F.abs(F.col("line_start") - F.col("mention_line")).alias("gap")
        place = F.struct(gap, "line_start", "chunk_index", "source", "section", "content")
        return near.groupBy("expansion").agg(F.min(place).alias("b")).select(
            "expansion", "b.source", "b.section", "b.line_start", "b.chunk_index", "b.content"
        )

    here = nearest(prose.join(mentions, (prose["source"] == mentions["source"]) & (F.col("line_start") == F.col("mention_line"))).drop(mentions["source"]).filter(holds))
    others = mentions.join(here.select("expansion"), "expansion", "left_anti")
    return here.unionByName(nearest(prose.join(others, "source").filter(holds))).orderBy("expansion")


def chunks_by_index(chunks: DataFrame, source: str, section: str, indices: list[int]) -> DataFrame:
    return chunks.filter(
        (F.col("source") == source) & (F.col("section") == section) & F.col("chunk_index").isin(indices)
    ).orderBy("chunk_index", "line_start")


def neighbor_chunks(
    chunks: DataFrame, source: str, line: int, before: int = 5, after: int = 5, include_anchor: bool = True
) -> DataFrame:
    """The chunks around one line of a source, in reading order: two bounded sorts, no window."""
    own = chunks.filter(F.col("source") == source)
    earlier = own.filter(F.col("line_start") < line).orderBy(F.desc("line_start"), F.desc("chunk_index")).limit(before)
    later = own.filter(F.col("line_start") > line).orderBy("line_start", "chunk_index").limit(after)
    parts = [earlier.withColumn("side", F.lit("before")), later.withColumn("side", F.lit("after"))]
    if include_anchor:
        anchor = own.filter(F.col("line_start") == line).orderBy("chunk_index").limit(1)
        parts.append(anchor.withColumn("side", F.lit("anchor")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy("line_start", "chunk_index")


def neighbors_of(chunks: DataFrame, anchors: DataFrame, before: int = 5, after: int = 5) -> DataFrame:
    """The same for many anchors (``source, line_start``), all of them lines of the table.

    Chunks get their position within the source once. Each anchor then asks for at most
    ``before + after`` positions, so the work is linear in anchors and no source is paired with itself.
    """
    order = ["line_start", "chunk_index"]
    placed = ranked(chunks.select("source", *order), ["source"], order, "pos")
    spans = placed.groupBy("source", "line_start").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    wanted = (
        anchors.select("source", "line_start").distinct()
        .join(spans, ["source", "line_start"])
        .select(
            "source",
            F.col("line_start").alias("anchor_line"),
            F.explode(
                F.concat(
                    F.transform(F.sequence(F.lit(1), F.lit(before)), lambda i: F.struct(F.lit("before").alias("side"), (F.col("lo") - i).alias("pos"))),
                    F.transform(F.sequence(F.lit(1), F.lit(after)), lambda i: F.struct(F.lit("after").alias("side"), (F.col("hi") + i).alias("pos"))),
                )
            ).alias("w"),
        )
        .select("source", "anchor_line", "w.side", "w.pos")
        .filter("pos > 0")
    )
    return wanted.join(placed, ["source", "pos"]).drop("pos")


def section_texts(chunks: DataFrame) -> DataFrame:
    """Text of every section: its chunks but table rows, in order, separated by a blank line.

    Sections longer than 1000 chunks continue in ``part`` 1, 2, …
    """
    body = chunks.filter("chunk_type <> 'table_row'").select(
        "source", "section", "line_start", "chunk_index", "line_end", "content"
    )
    item = F.struct("line_start", "line_end", "content")
    parts = in_parts(body, ["source", "section"], ["line_start", "chunk_index"], item, "items")
    filled = F.filter("items", lambda i: t.strip(i["content"]) != "")
    return parts.select(
        "source",
        "section",
        "part",
        F.get("items", F.lit(0))["line_start"].alias("line_start"),
        F.element_at("items", -1)["line_end"].alias("line_end"),
        F.array_join(F.transform(filled, lambda i: i["content"]), "\n\n").alias("content"),
    )


def section_content(chunks: DataFrame, source: str, section: str) -> DataFrame:
    return section_texts(chunks.filter((F.col("source") == source) & (F.col("section") == section)))


def similar_sections(chunks: DataFrame, source: str, section: str, limit: int | None = None) -> DataFrame:
    """Section names to offer when a section was not found: all, or the first ``limit``."""
    names = chunks.filter((F.col("source") == source) & t.contains_ci("section", section)).select("source", "section").distinct().orderBy("section")
    return names if limit is None else names.limit(limit)


def table_chunks(chunks: DataFrame, section: str, source: str | None = None, limit: int | None = None) -> DataFrame:
    """Table chunks of the sections whose name holds the text: all, or the first ``limit``."""
    hits = with_filters(chunks, None, source, section).filter(F.col("chunk_type").isin("table_row", "table_full"))
    ordered = hits.orderBy("source", "section", "line_start", "chunk_index")
    return ordered if limit is None else ordered.limit(limit)


def row_cells(headers: Column | str, cells: Column | str) -> Column:
    """Header → cell map from two JSON arrays; of equal headers the last one counts."""
    pairs = F.arrays_zip(
        F.from_json(headers, "array<string>").alias("h"), F.from_json(cells, "array<string>").alias("c")
    )
    named = F.filter(pairs, lambda p: p["h"].isNotNull())
    last = F.filter(
        named,
        lambda p, i: ~F.exists(F.slice(named, i + 2, F.greatest(F.size(named), F.lit(1))), lambda q: q["h"] == p["h"]),
    )
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["h"], p["c"])))


def read_table(chunks: DataFrame, source: str, section: str, limit: int | None = None) -> DataFrame:
    """Rows of the tables in a section as maps."""
    rows = table_chunks(chunks.filter("chunk_type = 'table_row'"), section, source, limit)
    return rows.select("source", "section", "line_start", "chunk_index", row_cells("table_headers", "content").alias("columns"))


def format_hits(hits: DataFrame, rank: str, max_chars: int | None = None) -> DataFrame:
    """Hits as readable text: rank and place, table cells as ``header: value`` pairs; with ``max_chars`` long content is cut."""
    pairs = F.arrays_zip(
        F.from_json("table_headers", "array<string>").alias("h"), F.from_json("content", "array<string>").alias("c")
    )
    shown = F.array_join(
        F.transform(
            F.filter(pairs, lambda p: (p["c"] != "") & p["h"].isNotNull()), lambda p: F.concat(p["h"], F.lit(": "), p["c"])
        ),
        "; ",
    )
    body = F.when((F.col("chunk_type") == "table_row") & (shown != ""), shown).otherwise(F.col("content"))
    cut = body if max_chars is None else F.when(F.length(body) > max_chars, F.concat(F.left(body, F.lit(max_chars)), F.lit("\n...[cut]"))).otherwise(body)
    head = F.concat(
        F.lit("["), F.col(rank).cast("string"), F.lit("] ["), F.col("source"), F.lit("]"),
        F.when(F.col("section") != "", F.concat(F.lit(" — "), F.col("section"))).otherwise(""),
        F.when(F.col("line_start") > 0, F.format_string(" (line %d)", F.col("line_start"))).otherwise(""),
    )
    return hits.withColumn("display", F.concat(head, F.lit("\n"), cut))


def sample_chunks(chunks: DataFrame, id_: str, n: int = 15, chunk_type: str | None = None, seed: int = 0) -> DataFrame:
    """``n`` chunks in an order that depends only on the row id and the seed."""
    order = F.md5(F.concat_ws(":", F.col(id_).cast("string"), F.lit(str(seed))))
    return with_filters(chunks, chunk_type).orderBy(order, id_).limit(n)
