"""Search over ``documents`` as prose chunks, ``part`` as named sections and ``embeddings``."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors
from ..operators import nearest, paging, search, sections
from .catalog import Tables, query


def chunks(t: Tables) -> DataFrame:
    """Documents as chunks: language is the section and the document number the line."""
    return t.documents.select(
        F.col("doc_id").alias("id"),
        "source",
        F.col("lang").alias("section"),
        F.lit("").alias("chunk_type"),
        F.lit("").alias("table_headers"),
        F.col("text").alias("content"),
        F.col("doc_id").alias("line_start"),
        (F.col("doc_id") + 1).alias("line_end"),
        F.col("doc_id").alias("chunk_index"),
    )


def named_chunks(t: Tables) -> DataFrame:
    """Parts as chunks of sections ``type > name`` in one source per brand."""
    return t.part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_brand").alias("source"),
        F.concat_ws(" > ", "p_type", "p_name").alias("section"),
        F.lit("").alias("chunk_type"),
        F.lit("").alias("table_headers"),
        F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("content"),
        F.col("p_partkey").alias("line_start"),
        F.col("p_partkey").alias("line_end"),
        F.col("p_partkey").alias("chunk_index"),
    )


def part_tables(t: Tables) -> DataFrame:
    """Parts as table rows, two columns and two headers, of a section per type."""
    return t.part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_brand").alias("source"),
        F.col("p_type").alias("section"),
        F.lit("table_row").alias("chunk_type"),
        F.lit('["Name","Size"]').alias("table_headers"),
        F.to_json(F.array("p_name", F.col("p_size").cast("string"))).alias("content"),
        F.col("p_partkey").alias("line_start"),
        F.col("p_partkey").alias("line_end"),
        F.col("p_partkey").alias("chunk_index"),
    )


# The vector searched for: any fixed direction will do.
PROBE = [round(math.sin(i + 1), 6) for i in range(64)]
PROBE_SQL = "[" + ", ".join(f"{x:.6f}" for x in PROBE) + "]::DOUBLE[]"

_CHUNKS = """
    c AS (SELECT doc_id AS id, source, lang AS section, text AS content, doc_id AS line_start, doc_id AS chunk_index
          FROM documents)
"""
_NAMED = """
    c AS (SELECT p_partkey AS id, p_brand AS source, p_type || ' > ' || p_name AS section,
                 p_name || ' ' || CAST(p_size AS VARCHAR) AS content, p_partkey AS line_start, p_partkey AS chunk_index FROM part)
"""


@query(f"WITH {_CHUNKS} SELECT id, source, section FROM c WHERE contains(lower(content), 'ereau')")
def exact_search(t: Tables) -> DataFrame:
    return search.exact_search(chunks(t), "EREAU").select("id", "source", "section")


@query(
    f"""WITH {_CHUNKS} SELECT id, source, section, row_number() OVER (ORDER BY line_start) AS rank FROM c
    WHERE contains(lower(content), 'ê') AND source = 'src3' AND contains(lower(section), 'f') ORDER BY line_start LIMIT 200"""
)
def exact_search_in_section(t: Tables) -> DataFrame:
    return search.exact_search(chunks(t), "Ê", 200, source="src3", section="F").select("id", "source", "section", "rank")


@query(
    f"""WITH {_CHUNKS}, m AS (
        SELECT *, CAST(contains(lower(content), 'the') AS INT) + CAST(contains(lower(content), 'mail') AS INT)
                  + CAST(contains(lower(content), 'license') AS INT) AS match_count FROM c)
    SELECT id, source, match_count, row_number() OVER (ORDER BY match_count DESC, source, line_start) AS rank
    FROM m WHERE match_count > 0 ORDER BY match_count DESC, source, line_start LIMIT 200"""
)
def multi_term_search(t: Tables) -> DataFrame:
    return search.multi_term_search(chunks(t), ["the", "mail", "License", "the"], 200).select("id", "source", "match_count", "rank")


@query(
    f"""WITH {_CHUNKS}, m AS (
        SELECT *, CAST(contains(lower(content), 'the') AS INT) + CAST(contains(lower(content), 'mail') AS INT)
                  + CAST(contains(lower(content), 'license') AS INT) AS match_count FROM c),
    n AS (SELECT match_count, count(*) AS chunks FROM m WHERE match_count > 0 GROUP BY match_count)
    SELECT match_count, chunks, CAST(sum(chunks) OVER () AS BIGINT) AS total_chunks, max(match_count) OVER () AS max_coverage FROM n"""
)
def coverage_groups(t: Tables) -> DataFrame:
    return search.coverage_groups(search.multi_term_search(chunks(t), ["the", "mail", "license"]))


@query(
    rf"""WITH {_CHUNKS},
    lim AS (SELECT * FROM c WHERE regexp_matches(content, '\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}')),
    x AS (SELECT source, line_start, regexp_extract_all(content, '\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}') AS found FROM lim),
    u AS (SELECT source, line_start, unnest(found) AS matched_text, unnest(range(len(found))) AS match_no FROM x)
    SELECT source, line_start, match_no, matched_text FROM u"""
)
def regex_search(t: Tables) -> DataFrame:
    found = search.regex_search(chunks(t), r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}")
    return found.select("source", "line_start", "match_no", "matched_text")


@query(
    rf"""WITH {_CHUNKS},
    x AS (SELECT source, line_start, regexp_extract_all(content, '(?i)t[a-z]*\s+a[a-z]*\s+o[a-z]*') AS found FROM c
          WHERE regexp_matches(content, '(?i)t[a-z]*\s+a[a-z]*\s+o[a-z]*')),
    u AS (SELECT source, line_start, unnest(found) AS m, unnest(range(len(found))) AS match_no FROM x),
    l AS (SELECT *, regexp_replace(m, '\s+', ' ', 'g') AS expansion FROM u),
    e AS (SELECT expansion, arg_min(source, (source, line_start, match_no)) AS source,
                 arg_min(line_start, (source, line_start, match_no)) AS mention FROM l GROUP BY expansion),
    j AS (SELECT e.expansion, c.source, c.section, c.line_start, abs(c.line_start - e.mention) AS gap FROM e JOIN c ON c.source = e.source
          AND contains(lower(c.content), lower(e.expansion)))
    SELECT expansion, source, section, line_start FROM j QUALIFY row_number() OVER (PARTITION BY expansion ORDER BY gap, line_start) = 1"""
)
def abbreviation_expansions(t: Tables) -> DataFrame:
    return search.find_expansions(chunks(t), "TAO").select("expansion", "source", "section", "line_start")


@query("SELECT count(*) AS chunks FROM (SELECT DISTINCT source, lang, text FROM documents)")
def count_chunks(t: Tables) -> DataFrame:
    return search.count_chunks(chunks(t))


@query("SELECT min(doc_id) AS id, source, lang AS section, length(text) AS chars FROM documents GROUP BY source, lang, text")
def stored_chunks(t: Tables) -> DataFrame:
    return search.stored_chunks(chunks(t)).select("id", "source", "section", F.length("content").alias("chars"))


@query("SELECT source, count(*) AS chunks_count FROM documents GROUP BY source")
def list_sources(t: Tables) -> DataFrame:
    return sections.list_sources(chunks(t))


@query("SELECT count(DISTINCT source) AS total_sources, count(*) AS total_chunks FROM documents")
def source_totals(t: Tables) -> DataFrame:
    return sections.source_totals(chunks(t))


@query(
    f"WITH {_NAMED} SELECT source, section, count(*) AS chunks_count FROM c GROUP BY ALL"
)
def list_sections(t: Tables) -> DataFrame:
    return sections.list_sections(named_chunks(t))


@query(f"WITH {_NAMED} SELECT DISTINCT source, string_split(section, ' > ')[-1] AS section FROM c")
def list_leaf_sections(t: Tables) -> DataFrame:
    return sections.list_leaf_sections(named_chunks(t))


@query(
    f"""WITH {_NAMED} SELECT source, section, count(*) AS chunk_count FROM c
    WHERE contains(lower(section), 'ring') AND contains(lower(section), 'small') GROUP BY ALL"""
)
def sections_by_name(t: Tables) -> DataFrame:
    return sections.sections_by_name(named_chunks(t), "Ring small")


@query(
    f"""WITH {_CHUNKS}, h AS (SELECT source, section FROM c WHERE contains(lower(content), 'tion'))
    SELECT source, section, count(*) AS match_count FROM h GROUP BY ALL"""
)
def sections_with_term(t: Tables) -> DataFrame:
    return sections.sections_with_term(chunks(t), "tion")


_TERMS = """
    t1 AS (SELECT source, section, count(*) AS match_count, 0 AS term_no FROM (
            SELECT * FROM c WHERE contains(lower(content), '{a}')) GROUP BY ALL),
    t2 AS (SELECT source, section, count(*) AS match_count, 1 AS term_no FROM (
            SELECT * FROM c WHERE contains(lower(content), '{b}')) GROUP BY ALL),
    tt AS (SELECT source, section, arg_min(match_count, term_no) AS match_count
           FROM (FROM t1 UNION ALL FROM t2) GROUP BY source, section)
"""


@query(f"WITH {_CHUNKS}, {_TERMS.format(a='license', b='mail')} SELECT source, section, match_count FROM tt")
def term_sections(t: Tables) -> DataFrame:
    return sections.term_sections(chunks(t), ["license", "mail"]).select("source", "section", "match_count")


_GRAMS = """
    q AS (SELECT [substring('{q}', i, 3) FOR i IN range(1, length('{q}') - 1)] AS qg),
    n AS (SELECT DISTINCT source, section FROM c WHERE section <> ''),
    gr AS (SELECT source, section, CASE WHEN length(section) < 3 THEN []
                  ELSE [substring(lower(section), i, 3) FOR i IN range(1, length(section) - 1)] END AS g FROM n),
    fz AS (SELECT source, section,
                  (len(g) + len(qg) - 2 * list_sum([least(len(list_filter(qg, lambda y: y = x)), len(list_filter(g, lambda y: y = x)))
                   FOR x IN list_distinct(qg)])) / (len(g) + len(qg)) AS distance FROM gr, q)
"""


@query(
    f"""WITH {_NAMED}, {_GRAMS.format(q='economy smal rign')}
    SELECT source, section, round(distance, 6) AS distance FROM (SELECT * FROM fz ORDER BY distance, source, section LIMIT 40) WHERE distance <= 0.82"""
)
def fuzzy_sections(t: Tables) -> DataFrame:
    near = sections.fuzzy_sections(named_chunks(t), "Economy smal rign", 40, 0.82)
    return near.select("source", "section", F.round("distance", 6).alias("distance"))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_LETTER_SQL = "[" + ", ".join(f"length({{s}}) - length(replace({{s}}, '{c}', ''))" for c in _LETTERS) + "]"


def letter_probe(text: str) -> list[float]:
    return [float(text.lower().count(c)) for c in _LETTERS]


_SEM = f"""
    ix AS (SELECT DISTINCT source, section, {_LETTER_SQL.format(s="lower(section)")}::DOUBLE[] AS v FROM c WHERE section <> ''),
    sm AS (SELECT source, section, greatest(1 - list_cosine_similarity(v, {{p}}::DOUBLE[]), 0) AS distance FROM ix)
"""


@query(
    f"""WITH {_NAMED}, {_SEM.format(p=letter_probe("little rings, promoted"))}
    SELECT source, section, round(distance, 6) AS distance FROM (SELECT * FROM sm ORDER BY distance, source, section LIMIT 15)
    WHERE distance <= 0.58"""
)
def semantic_sections(t: Tables) -> DataFrame:
    index = sections.build_section_index(named_chunks(t), nearest.letter_vector)
    near = sections.semantic_sections(index, letter_probe("little rings, promoted"), 15, sections.SEMANTIC_MAX_DISTANCE)
    return near.select("source", "section", F.round("distance", 6).alias("distance"))


@query(f"WITH {_NAMED}, {_SEM.format(p=letter_probe('x'))} SELECT source, section, array_to_string(v::INT[], ',') AS vector FROM ix")
def section_index(t: Tables) -> DataFrame:
    index = sections.build_section_index(named_chunks(t), nearest.letter_vector)
    return index.select(
        "source", "section", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("vector")
    )


@query(
    f"""WITH {_NAMED}, {_SEM.format(p=letter_probe("cold rod"))}, {_GRAMS.format(q='cold rod')}, {_TERMS.format(a='ring 7', b='hot')},
    b AS (
        SELECT source, section, 0 AS priority, -count(*)::DOUBLE AS sort_val, count(*) AS match_count, NULL::DOUBLE AS score FROM c
        WHERE contains(lower(section), 'cold') AND contains(lower(section), 'rod') GROUP BY ALL
        UNION ALL
        SELECT source, section, 1, distance, CAST(round_even((1 - distance) * 100, 0) AS BIGINT), round(1 - distance, 4)
        FROM (SELECT * FROM sm ORDER BY distance, source, section LIMIT 15) WHERE distance <= 0.58
        UNION ALL
        SELECT source, section, 2, distance, CAST(round_even((1 - distance) * 100, 0) AS BIGINT), round(1 - distance, 4)
        FROM (SELECT * FROM fz ORDER BY distance, source, section LIMIT 100) WHERE distance <= 0.82
        UNION ALL
        SELECT source, section, 3, -match_count::DOUBLE, match_count, NULL FROM tt),
    w AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY source, section ORDER BY priority) = 1)
    SELECT source, section, match_count, coalesce(score, -1) AS score, ['NAME', 'SEMANTIC', 'FUZZY', 'CONTENT'][priority + 1] AS match_type
    FROM w ORDER BY priority, sort_val, source, section LIMIT 200"""
)
def search_sections(t: Tables) -> DataFrame:
    parts = named_chunks(t)
    index = sections.build_section_index(parts, nearest.letter_vector)
    found = sections.search_sections(
        parts, index, "cold rod", letter_probe("cold rod"), ["ring 7", "hot"], limit=200, fuzzy_top_k=100
    )
    return found.select("source", "section", "match_count", F.coalesce("score", F.lit(-1.0)).alias("score"), "match_type")


@query(f"WITH {_CHUNKS} SELECT id, source, section FROM c WHERE source = 'src5' AND section = 'en' AND chunk_index IN (5, 25, 45, 65, 85)")
def chunks_by_index(t: Tables) -> DataFrame:
    return search.chunks_by_index(chunks(t), "src5", "en", [5, 25, 45, 65, 85]).select("id", "source", "section")


@query(
    f"""WITH {_CHUNKS}
    FROM (SELECT id, 'before' AS side FROM c WHERE source = 'src7' AND line_start < 507 ORDER BY line_start DESC LIMIT 5)
    UNION ALL FROM (SELECT id, 'after' AS side FROM c WHERE source = 'src7' AND line_start > 507 ORDER BY line_start LIMIT 5)
    UNION ALL FROM (SELECT id, 'anchor' AS side FROM c WHERE source = 'src7' AND line_start = 507)"""
)
def neighbor_chunks(t: Tables) -> DataFrame:
    return search.neighbor_chunks(chunks(t), "src7", 507).select("id", "side")


@query(
    f"""WITH {_CHUNKS}, p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY line_start, chunk_index) AS pos FROM c),
    a AS (SELECT * FROM p WHERE contains(lower(content), 'license'))
    SELECT a.source, a.line_start AS anchor_line, CASE WHEN p.pos < a.pos THEN 'before' ELSE 'after' END AS side, p.line_start
    FROM a JOIN p ON p.source = a.source AND p.pos <> a.pos AND p.pos BETWEEN a.pos - 2 AND a.pos + 2"""
)
def neighbors_of_hits(t: Tables) -> DataFrame:
    own = chunks(t)
    hits = own.filter(tx.contains_ci("content", "license"))
    return search.neighbors_of(own, hits, 2, 2).select("source", "anchor_line", "side", "line_start")


@query(
    f"""WITH {_CHUNKS}, p AS (SELECT *, row_number() OVER (PARTITION BY source, section ORDER BY line_start, chunk_index) AS rn FROM c)
    SELECT source, section, (rn - 1) // 1000 AS part, min(line_start) AS line_start, max(line_start) + 1 AS line_end,
           md5(string_agg(content, chr(10) || chr(10) ORDER BY rn) FILTER (WHERE trim(content) <> '')) AS digest
    FROM p GROUP BY ALL"""
)
def section_texts(t: Tables) -> DataFrame:
    out = search.section_texts(chunks(t))
    return out.select("source", "section", "part", "line_start", "line_end", F.md5("content").alias("digest"))


@query(
    f"""WITH {_CHUNKS}
    SELECT min(line_start) AS line_start, max(line_start) + 1 AS line_end,
           string_agg(content, chr(10) || chr(10) ORDER BY line_start) AS content
    FROM c WHERE source = 'src2' AND section = 'es'"""
)
def section_content(t: Tables) -> DataFrame:
    return search.section_content(chunks(t), "src2", "es").select("line_start", "line_end", "content")


@query(
    f"""WITH {_NAMED} SELECT DISTINCT source, section FROM c WHERE source = 'Brand#4' AND contains(lower(section), 'gear')
    ORDER BY section"""
)
def similar_sections(t: Tables) -> DataFrame:
    return search.similar_sections(named_chunks(t), "Brand#4", "GEAR")


@query(
    """SELECT p_partkey AS id, p_brand AS source FROM part WHERE contains(lower(p_type), 'medium')"""
)
def table_chunks(t: Tables) -> DataFrame:
    return search.table_chunks(part_tables(t), "Medium").select("id", "source")


@query(
    """SELECT p_partkey AS line_start, p_name AS name, CAST(p_size AS VARCHAR) AS size FROM part
    WHERE p_brand = 'Brand#7' AND contains(lower(p_type), 'o')"""
)
def read_table(t: Tables) -> DataFrame:
    rows = search.read_table(part_tables(t), "Brand#7", "O")
    return rows.select("line_start", F.col("columns")["Name"].alias("name"), F.col("columns")["Size"].alias("size"))


@query(
    """SELECT p_partkey AS id, '[' || CAST(p_partkey AS VARCHAR) || '] [' || p_brand || '] — ' || p_type
           || CASE WHEN p_partkey > 0 THEN ' (line ' || CAST(p_partkey AS VARCHAR) || ')' ELSE '' END
           || chr(10) || 'Name: ' || p_name || '; Size: ' || CAST(p_size AS VARCHAR) AS display FROM part"""
)
def display_table_rows(t: Tables) -> DataFrame:
    return search.format_hits(part_tables(t), "id").select("id", "display")


@query(
    f"""WITH {_CHUNKS} SELECT id, '[' || CAST(id AS VARCHAR) || '] [' || source || '] — ' || section
           || CASE WHEN line_start > 0 THEN ' (line ' || CAST(line_start AS VARCHAR) || ')' ELSE '' END || chr(10)
           || content AS display FROM c"""
)
def display_hits(t: Tables) -> DataFrame:
    return search.format_hits(chunks(t), "id").select("id", "display")


@query("SELECT doc_id AS id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || ':7'), doc_id LIMIT 15")
def sample_chunks(t: Tables) -> DataFrame:
    return search.sample_chunks(chunks(t), "id", 15, seed=7).select("id")


@query(
    f"""WITH {_NAMED}, n AS (SELECT source, section, count(*) AS chunk_count FROM c GROUP BY ALL)
    SELECT * FROM n ORDER BY chunk_count DESC, source, section LIMIT 50 OFFSET 100"""
)
def section_page(t: Tables) -> DataFrame:
    counted = sections.sections_by_name(named_chunks(t), "")
    allowed = {"size": [F.desc("chunk_count"), F.col("source"), F.col("section")], "name": [F.col("section"), F.col("source")]}
    return paging.page(paging.sort_by(counted, "size", allowed, "name"), 3, 50)


@query(
    f"""WITH {_NAMED}, n AS (SELECT source, section, count(*) AS chunk_count FROM c GROUP BY ALL)
    SELECT count(*) AS total, CAST(ceil(count(*) / 50) AS BIGINT) AS total_pages FROM n"""
)
def section_page_totals(t: Tables) -> DataFrame:
    return paging.page_totals(sections.sections_by_name(named_chunks(t), ""), 50)


# --- vectors ---


def vector_chunks(t: Tables) -> DataFrame:
    return t.embeddings.select(
        F.col("vec_id").alias("id"), F.lit("").alias("chunk_type"),
        F.concat(F.lit("label "), F.col("label").cast("string")).alias("section"), F.lit("vectors").alias("source"), "embedding",
    )


_DIST = f"greatest(1 - list_cosine_similarity(embedding::DOUBLE[], {PROBE_SQL}), 0)"


@query(f"SELECT vec_id AS id, round({_DIST}, 6) AS distance FROM embeddings ORDER BY {_DIST}, vec_id LIMIT 10")
def semantic_search(t: Tables) -> DataFrame:
    return nearest.semantic_search(vector_chunks(t), PROBE).select("id", F.round("distance", 6).alias("distance"))


@query(
    f"""SELECT vec_id AS id, round({_DIST}, 6) AS distance FROM embeddings WHERE label = 3 ORDER BY {_DIST}, vec_id LIMIT 20"""
)
def semantic_search_in_section(t: Tables) -> DataFrame:
    hits = nearest.semantic_search(vector_chunks(t), PROBE, 20, section="LABEL 3")
    return hits.select("id", F.round("distance", 6).alias("distance"))


# Several fixed directions as a batch of queries.
PROBES = [(f"q{n:02d}", [round(math.sin((i + 1) * (n + 1)), 6) for i in range(64)]) for n in range(20)]
_PROBES_SQL = "VALUES " + ", ".join(f"('{n}', [{', '.join(f'{x:.6f}' for x in v)}]::DOUBLE[])" for n, v in PROBES)
_EACH = f"""
    q(query, v) AS ({_PROBES_SQL}),
    d AS (SELECT query, vec_id, label, greatest(1 - list_cosine_similarity(embedding::DOUBLE[], v), 0) AS distance FROM embeddings, q),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS rank FROM d QUALIFY rank <= 10)
"""


@query(
    """WITH q AS (SELECT vec_id AS query, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label = 3),
    d AS (SELECT query, vec_id, greatest(1 - list_cosine_similarity(embedding::DOUBLE[], v), 0) AS distance FROM embeddings, q),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 12), vec_id) AS rank FROM d QUALIFY rank <= 5)
    SELECT query, vec_id AS id, rank, round(distance, 6) AS distance FROM r WHERE vec_id <> query"""
)
def nearest_to_table(t: Tables) -> DataFrame:
    """Every vector of one label asks all vectors."""
    asked = t.embeddings.filter("label = 3").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    found = nearest.nearest_to_each(vector_chunks(t), asked, 5)
    return found.filter("id <> query").select("query", "id", "rank", F.round("distance", 6).alias("distance"))


@query(f"WITH {_EACH} SELECT query, vec_id AS id, rank, round(distance, 6) AS distance FROM r")
def nearest_to_each(t: Tables) -> DataFrame:
    found = nearest.nearest_to_each(vector_chunks(t), PROBES, 10)
    return found.select("query", "id", "rank", F.round("distance", 6).alias("distance"))


@query(
    f"""WITH {_EACH} SELECT query, 0 AS part, string_agg('[vectors] — label ' || CAST(label AS VARCHAR) || chr(10) || 'vector '
        || CAST(vec_id AS VARCHAR), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM r GROUP BY query"""
)
def retrieved_context(t: Tables) -> DataFrame:
    own = vector_chunks(t)
    found = nearest.nearest_to_each(own, PROBES, 10)
    rows = own.select("id", "source", "section", F.concat(F.lit("vector "), F.col("id").cast("string")).alias("content"))
    return nearest.retrieve_context(found.join(rows, "id"))


_PERSONS = f"""
    d AS (SELECT label, {_DIST} AS distance FROM embeddings),
    p AS (SELECT n_nationkey AS person_id, n_name AS name, min(distance) AS distance, count(*) AS face_count
          FROM d JOIN nation ON n_nationkey = label WHERE n_name IS NOT NULL AND n_name <> '' GROUP BY ALL
          ORDER BY 3, 1 LIMIT 20)
"""


def _near_persons(t: Tables) -> DataFrame:
    vecs = t.embeddings.select(F.col("vec_id").alias("face_id"), "embedding")
    faces = t.embeddings.select(F.col("vec_id").alias("face_id"), F.col("label").alias("person_id"))
    persons = t.nation.select(F.col("n_nationkey").alias("person_id"), F.col("n_name").alias("name"))
    return nearest.nearest_persons(vecs, faces, persons, PROBE)


@query(f"WITH {_PERSONS} SELECT person_id, name, round(distance, 4) AS distance, face_count FROM p")
def nearest_persons(t: Tables) -> DataFrame:
    return _near_persons(t)


@query(
    f"""WITH {_PERSONS} SELECT person_id, CASE WHEN 1 - round(distance, 4) >= 0.5 OR row_number() OVER (ORDER BY distance, person_id) = 1
        THEN 1 ELSE 0 END AS strong, round(least(greatest((1 - round(distance, 4)) * 100, 0), 100), 2) AS percent FROM p"""
)
def split_matches(t: Tables) -> DataFrame:
    marked = nearest.split_matches(_near_persons(t))
    return marked.select(
        "person_id", F.col("strong").cast("int").alias("strong"), F.round(vectors.match_percent("distance"), 2).alias("percent")
    )


@query(
    f"""SELECT doc_id AS id, array_to_string({_LETTER_SQL.format(s="lower(text)")}::INT[], ',') AS vector FROM documents"""
)
def embedded_documents(t: Tables) -> DataFrame:
    def count_letters(texts: list[str]) -> list[list[float]]:
        return [[float(s.lower().count(c)) for c in _LETTERS] for s in texts]

    out = nearest.embed(t.documents.select("doc_id", "text"), "text", count_letters)
    joined = F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",")
    return out.select(F.col("doc_id").alias("id"), joined.alias("vector"))
