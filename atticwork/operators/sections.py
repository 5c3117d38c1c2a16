"""Finding and listing sections."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy, vectors
from ..functions import text as t
from .dedup import first_per_key
from .search import with_filters

# How far a section name may be from the query, by meaning and by spelling.
SEMANTIC_MAX_DISTANCE = 0.58
FUZZY_MAX_DISTANCE = 0.82

NAME, SEMANTIC, FUZZY, CONTENT = range(4)


def list_sources(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source").agg(F.count(F.lit(1)).alias("chunks_count")).orderBy("source")


def source_totals(chunks: DataFrame) -> DataFrame:
    return list_sources(chunks).agg(
        F.count(F.lit(1)).alias("total_sources"), F.coalesce(F.sum("chunks_count"), F.lit(0)).alias("total_chunks")
    )


def list_sections(chunks: DataFrame, source: str | None = None) -> DataFrame:
    """All named sections with their chunk counts, in order."""
    named = with_filters(chunks, source=source).filter("section <> ''")
    return named.groupBy("source", "section").agg(F.count(F.lit(1)).alias("chunks_count")).orderBy("source", "section")


def list_leaf_sections(chunks: DataFrame) -> DataFrame:
    """Distinct (source, last breadcrumb level)."""
    leaf = t.strip(F.element_at(F.split("section", " > "), -1))
    return chunks.filter("section <> ''").select("source", leaf.alias("section")).distinct()


def sections_by_name(chunks: DataFrame, query: str, source: str | None = None) -> DataFrame:
    """Sections whose name has all words of the query; an empty query has no words and matches all."""
    named = with_filters(chunks, source=source).filter(t.contains_all("section", query.split()))
    return named.groupBy("source", "section").agg(F.count(F.lit(1)).alias("chunk_count"))


def sections_with_term(chunks: DataFrame, term: str, chunk_type: str | None = None, source: str | None = None) -> DataFrame:
    """Sections with the number of their chunks that hold the term."""
    hits = with_filters(chunks, chunk_type, source).filter(t.contains_ci("content", term))
    return hits.groupBy("source", "section").agg(F.count(F.lit(1)).alias("match_count"))


def term_sections(chunks: DataFrame, terms: list[str], source: str | None = None) -> DataFrame:
    """Sections holding any of the terms; the count is that of the first term found there, ``term_no`` its place in the list.

    One scan counts all terms."""
    held = [t.contains_ci("content", term) for term in terms]
    rows = with_filters(chunks, source=source).filter(reduce(Column.__or__, held))
    counts = F.array(*[F.count_if(h) for h in held]).alias("counts")
    counted = rows.groupBy("source", "section").agg(counts)
    first = F.array_position(F.transform("counts", lambda n: n > 0), True)
    return counted.select(
        "source", "section", F.element_at("counts", first.cast("int")).alias("match_count"), (first - 1).cast("int").alias("term_no")
    )


def fuzzy_sections(
    chunks: DataFrame, query: str, k: int = 10, max_distance: float | None = None, source: str | None = None
) -> DataFrame:
    """Section names closest in spelling. The threshold is applied to the ``k`` best, so fewer may come.

    Names are made distinct before the distance is computed."""
    names = with_filters(chunks, source=source).filter("section <> ''").select("source", "section").distinct()
    best = (
        names.withColumn("distance", fuzzy.qgram_distance("section", query))
        .orderBy("distance", "source", "section")
        .limit(k)
    )
    return best if max_distance is None else best.filter(F.col("distance") <= max_distance)


def build_section_index(chunks: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """Vector per distinct named section; sections whose vector failed or has a NaN are left out."""
    names = chunks.filter("section <> ''").select("source", "section").distinct()
    clean = t.embedding_text("section")
    text = F.when(clean != "", clean).otherwise(F.col("section"))
    # Exploding a list of one keeps the optimizer from copying the text expression into every use of it.
    texts = names.select("source", "section", F.explode(F.array(text)).alias("_text"))
    embedded = texts.withColumn("embedding", embed(F.col("_text"))).drop("_text")
    return embedded.filter(F.col("embedding").isNotNull() & ~vectors.has_nan("embedding"))


def semantic_sections(
    index: DataFrame, vec: list[float], k: int = 15, max_distance: float | None = None, source: str | None = None
) -> DataFrame:
    best = (
        with_filters(index, source=source)
        .select("source", "section", vectors.cosine_distance(F.col("embedding"), vec).alias("distance"))
        .orderBy(F.asc_nulls_last("distance"), "source", "section")
        .limit(k)
    )
    return best if max_distance is None else best.filter(F.col("distance") <= max_distance)


def search_sections(
    chunks: DataFrame,
    index: DataFrame,
    query: str,
    query_vec: list[float],
    exact_terms: list[str] | None = None,
    limit: int | None = None,
    semantic_top_k: int = 15,
    fuzzy_top_k: int = 10,
    source: str | None = None,
) -> DataFrame:
    """Sections found by name, meaning, spelling or content, in that order of trust.

    A section found several ways is listed once under the most trusted one. All are listed, or the first ``limit``.
    """
    def branch(df: DataFrame, priority: int, count: Column, score: Column, rank: Column) -> DataFrame:
        return df.select(
            "source", "section",
            F.lit(priority).alias("priority"),
            rank.cast("double").alias("sort_val"),
            count.cast("long").alias("match_count"),
            score.cast("double").alias("score"),
        )

    none = F.lit(None)
    closeness = 1 - F.col("distance")
    percent = F.bround(closeness * 100)
    parts = [branch(sections_by_name(chunks, query, source), NAME, F.col("chunk_count"), none, -F.col("chunk_count"))]
    if query:
        near = semantic_sections(index, query_vec, semantic_top_k, SEMANTIC_MAX_DISTANCE, source)
        alike = fuzzy_sections(chunks, query, fuzzy_top_k, FUZZY_MAX_DISTANCE, source)
        for df, priority in ((near, SEMANTIC), (alike, FUZZY)):
            parts.append(branch(df, priority, percent, F.round(closeness, 4), F.col("distance")))
    if exact_terms:
        held = term_sections(chunks, exact_terms, source)
        parts.append(branch(held, CONTENT, F.col("match_count"), none, -F.col("match_count")))
    found = first_per_key(reduce(DataFrame.unionByName, parts), ["source", "section"], ["priority"])
    names = F.array(*[F.lit(n) for n in ("NAME", "SEMANTIC", "FUZZY", "CONTENT")])
    ordered = found.orderBy("priority", "sort_val", "source", "section")
    return (ordered if limit is None else ordered.limit(limit)).withColumn("match_type", F.get(names, F.col("priority")))
