"""Books and corpus work over ``documents``: sections are lines, leaves their sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import books as b
from ..operators import chunking as ch
from .catalog import Tables, query


def trees(t: Tables) -> DataFrame:
    """Every document as a book: lines are sections, their sentences the nested sections."""
    lines = F.filter(F.split("text", "\n"), lambda line: tx.strip(line) != "")
    tree = F.transform(
        lines,
        lambda line, i: F.struct(
            F.concat(F.lit("Part "), (i + 1).cast("string")).alias("title"),
            F.array(line).alias("p"),
            F.transform(
                tx.sentences(line),
                lambda s, k: F.struct(F.concat(F.lit(" "), (k + 1).cast("string"), F.lit(" ")).alias("title"), F.array(s).alias("p")),
            ).alias("section"),
        ),
    )
    return t.documents.select(F.col("doc_id").alias("book"), tree.alias("sections"))


_TREE = r"""
    l0 AS (SELECT doc_id AS book, list_filter(string_split(text, chr(10)), lambda x: trim(x, E' \t\r') <> '') AS ls FROM documents),
    l1 AS (SELECT book, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM l0),
    l2 AS (SELECT book, i, list_filter(list_transform(string_split(regexp_replace(trim(line, E' \t\r'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
                  lambda x: trim(x, E' \t\r')), lambda x: x <> '') AS ss FROM l1),
    leaf AS (SELECT book, i, unnest(ss) AS content, unnest(range(len(ss))) AS k FROM l2),
    named AS (SELECT *, 'Part ' || CAST(i + 1 AS VARCHAR) || ' - ' || CAST(k + 1 AS VARCHAR) AS title FROM leaf)
"""


@query(f"WITH {_TREE} SELECT book, title, content FROM named")
def book_leaves(t: Tables) -> DataFrame:
    return b.flatten_sections(trees(t)).select("book", "title", "content")


@query(
    f"""WITH {_TREE}, r AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY i, k) - 1 AS idx FROM named)
    SELECT book, title, idx, printf('%04d', idx) || '_' || replace(replace(lower(title), ' - ', '_'), ' ', '_') AS file_name FROM r"""
)
def numbered_sections(t: Tables) -> DataFrame:
    return b.number_sections(b.flatten_sections(trees(t))).select("book", "title", "idx", "file_name")


@query(
    """SELECT d.doc_id, d.source AS book, coalesce(m, -1) + row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) AS idx
    FROM documents d LEFT JOIN (SELECT source, max(n_chars) AS m FROM documents JOIN labels USING (doc_id) WHERE lang = 'fr' GROUP BY source) x ON x.source = d.source
    WHERE d.lang <> 'fr'"""
)
def continued_index(t: Tables) -> DataFrame:
    existing = t.documents.filter("lang = 'fr'").join(t.labels, "doc_id").select(F.col("source").alias("book"), F.col("n_chars").alias("idx"))
    new = t.documents.filter("lang <> 'fr'").select("doc_id", F.col("source").alias("book"))
    return b.continue_index(new, existing, ["book"], ["doc_id"])


@query(
    """SELECT doc_id, n_chars, md5(text) AS prompt FROM documents
    WHERE length(trim(text, E' \t\n\r')) >= 1000 AND doc_id NOT IN (SELECT doc_id FROM labels)"""
)
def summary_queue(t: Tables) -> DataFrame:
    sections = t.documents.select("doc_id", "n_chars", F.col("text").alias("content"))
    todo = b.summary_queue(sections, t.labels, ["doc_id"], b.MIN_SINGLE)
    return todo.select("doc_id", "n_chars", F.md5("prompt_text").alias("prompt"))


@query(
    """SELECT count(*) AS total, count(*) FILTER (WHERE toxic = 0) AS ok, count(*) FILTER (WHERE toxic = 1) AS failed,
    CAST(sum(quality * 2 + 1) AS DOUBLE) AS total_time, round(avg(quality * 2 + 1), 9) AS avg_time FROM labels"""
)
def run_summary(t: Tables) -> DataFrame:
    runs = t.labels.select(
        F.col("doc_id").cast("string").alias("model"), (F.col("quality") * 2 + 1).cast("double").alias("duration"),
        (F.col("toxic") == 0).alias("success"), F.lit(None).cast("string").alias("error"),
    )
    return b.run_summary(runs).withColumn("avg_time", F.round("avg_time", 9))


@query("SELECT CAST(doc_id AS VARCHAR) AS model, 'toxic' AS error FROM labels WHERE toxic = 1")
def failed_runs(t: Tables) -> DataFrame:
    runs = t.labels.select(F.col("doc_id").cast("string").alias("model"), (F.col("toxic") == 0).alias("success"), F.lit("toxic").alias("error"))
    return b.failed_runs(runs)


_PACKED = rf"""
WITH RECURSIVE s0 AS (
    SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(text, '\n{{3,}}', chr(10) || chr(10), 'g'), E' \t\r\n'),
               '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, E' \t\r\n')), lambda x: x <> '') AS ss FROM documents
),
s1 AS (SELECT doc_id, unnest(ss) AS sentence, unnest(range(len(ss))) AS i FROM s0),
s2 AS (SELECT doc_id, i, sum(length(sentence) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM s1),
s AS MATERIALIZED (
    SELECT doc_id, ss, list_concat([0], (SELECT list(CAST(upto AS BIGINT) ORDER BY i) FROM s2 WHERE s2.doc_id = s0.doc_id)) AS b
    FROM s0 WHERE len(ss) > 0
),
runs AS (
    SELECT doc_id, b, 0 AS run, 0 AS opened, greatest(1, len(list_filter(b, lambda x: x <= {b.PACK_MAX} + 1)) - 1) AS stop, 0 AS first FROM s
    UNION ALL
    SELECT doc_id, b, CASE WHEN joined THEN run ELSE run + 1 END, CASE WHEN joined THEN opened ELSE next END, next_stop, next
    FROM (
        SELECT *, b[next_stop + 1] - 1 - b[next + 1] < {b.PACK_MIN} AS joined
        FROM (
            SELECT *, greatest(next + 1, len(list_filter(b, lambda x: x <= b[next + 1] + {b.PACK_MAX} + 1)) - 1) AS next_stop
            FROM (
                SELECT *, least(stop, greatest(first + 1, len(list_filter(b, lambda x: x <= b[stop + 1] - {b.PACK_OVERLAP})) - 1,
                    len(list_filter(b, lambda x: x < b[stop + 2] - 1 - {b.PACK_MAX})))) AS next
                FROM runs WHERE stop < len(b) - 1
            )
        )
    )
),
spans AS (SELECT doc_id, run, min(opened) AS a, max(stop) AS z FROM runs GROUP BY ALL)
SELECT doc_id, run AS chunk_no, array_to_string(ss[a + 1:z], ' ') AS chunk_text, b[a + 1] AS start_pos, b[z + 1] - 1 AS end_pos
FROM spans JOIN s USING (doc_id)
"""


@query(_PACKED)
def packed_sentences(t: Tables) -> DataFrame:
    out = b.pack_sentences(t.documents.select("doc_id", "text"), "text")
    return out.select("doc_id", "chunk_no", "chunk_text", "start_pos", "end_pos")


@query(
    """SELECT doc_id, length(replace(text, chr(10), '')) AS chars FROM documents"""
)
def long_section_chars(t: Tables) -> DataFrame:
    """Cutting long sections loses no character: per document, the characters of its parts."""
    own = t.documents.select("doc_id", F.lit("Doc").alias("title"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("content"))
    parts = b.split_long_section(own, "title", "content", 2000)
    size = F.length(F.replace("part_content", F.lit("\n"), F.lit("")))
    return parts.groupBy("doc_id").agg(F.sum(size).alias("chars"))


@query(
    f"""WITH RECURSIVE c AS (
        SELECT doc_id, length(x) AS size, CAST(floor(length(x) / ceil(length(x) / 2000.0)) AS BIGINT) AS target,
               CASE WHEN length(x) > 2000 THEN string_split(x, chr(10) || chr(10)) ELSE [x] END AS ps
        FROM (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS x FROM documents)),
    fold AS (
        SELECT doc_id, ps, target, 1 AS i, length(ps[1]) + 2 AS held, 0 AS part_no FROM c
        UNION ALL
        SELECT doc_id, ps, target, i + 1, CASE WHEN more THEN length(ps[i + 1]) ELSE held + length(ps[i + 1]) + 2 END, part_no + CAST(more AS INT)
        FROM (SELECT *, held + length(ps[i + 1]) + 2 > target AS more FROM fold WHERE i < len(ps)))
    SELECT doc_id, part_no, CASE WHEN any_value(size) > 2000 THEN 'Doc - {b.PART_WORD} ' || CAST(part_no + 1 AS VARCHAR) ELSE 'Doc' END AS part_title,
        string_agg(fold.ps[i], chr(10) || chr(10) ORDER BY i) AS part_content
    FROM fold JOIN c USING (doc_id) GROUP BY doc_id, part_no"""
)
def long_section_parts(t: Tables) -> DataFrame:
    own = t.documents.select("doc_id", F.lit("Doc").alias("title"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("content"))
    return b.split_long_section(own, "title", "content", 2000).select("doc_id", "part_no", "part_title", "part_content")


# --- corpus ---


def corpus(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("doc"), "source", "text")


def markdown_corpus(t: Tables) -> DataFrame:
    """Documents given Markdown structure: the first line becomes a title, a parts table is not there,
    every other line a paragraph of its own."""
    lines = F.split("text", "\n")
    shaped = F.transform(lines, lambda line, i: F.when(i == 0, F.concat(F.lit("# "), line)).otherwise(line))
    return t.documents.select(F.col("doc_id").alias("doc"), "source", F.array_join(shaped, "\n\n").alias("text"))


def _place(mark: str, length: int) -> str:
    """Where a slice from column ``pos`` ends if it ends before the last such separator in reach."""
    window = f"substr(content, pos + {ch.CHUNK_OVERLAP + 2}, {ch.CHUNK_SIZE + length - ch.CHUNK_OVERLAP - 1})"
    found = f"strpos(reverse({window}), {mark})"
    return f"CASE WHEN {found} > 0 THEN pos + {ch.CHUNK_OVERLAP + 1} + length({window}) - {found} - {length - 1} END"


_STOP = (
    f"CASE WHEN length(content) - pos <= {ch.CHUNK_SIZE} THEN length(content) "
    f"ELSE coalesce({_place('chr(10) || chr(10)', 2)}, {_place('chr(10)', 1)}, {_place(chr(39) + ' ' + chr(39), 1)}, pos + {ch.CHUNK_SIZE}) END"
)


def _chunks_sql(body: str) -> str:
    """Chunks of prose blocks: body(doc, source, section, block, line_start, line_end, content)."""
    return f"""WITH RECURSIVE body AS MATERIALIZED ({body}),
    cuts AS (
        SELECT doc, block, 0 AS k, content, pos, {_STOP} AS stop FROM (SELECT *, 0 AS pos FROM body)
        UNION ALL
        SELECT doc, block, k, content, pos, {_STOP} FROM (
            SELECT doc, block, k + 1 AS k, content, greatest(stop - {ch.CHUNK_OVERLAP}, pos + 1) AS pos FROM cuts WHERE length(content) - pos > {ch.CHUNK_SIZE})
    ),
    pieces AS (
        SELECT doc, block, 0 AS k, 'paragraph_full' AS chunk_type, content AS piece FROM body
        UNION ALL SELECT doc, block, k, '', substr(content, pos + 1, stop - pos) FROM cuts
    )
    SELECT doc, source, section, line_start, line_end, chunk_type, '' AS table_headers, piece AS content,
        row_number() OVER (PARTITION BY doc, section, chunk_type ORDER BY block, k) AS chunk_index
    FROM pieces JOIN body USING (doc, block) WHERE trim(piece, E' \\t\\r\\n') <> ''"""


# Neither corpus has lines that Markdown would take for anything but text.
@query(
    _chunks_sql(
        r"""SELECT doc, source, section, i AS block, 2 * i + 1 AS line_start, 2 * i + 1 AS line_end, trim(line, E' \t\r') AS content
        FROM (SELECT doc_id AS doc, source, trim(regexp_replace(string_split(text, chr(10))[1], '[*`]|__', '', 'g'), E' \t\r') AS section,
                     unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
        WHERE i > 0 AND trim(line, E' \t\r') <> ''"""
    )
)
def chunked_corpus(t: Tables) -> DataFrame:
    return ch.chunk_markdown(markdown_corpus(t))


@query(
    _chunks_sql(
        r"""SELECT doc_id AS doc, source, '' AS section, 0 AS block, 1 AS line_start, len(string_split(text, chr(10))) AS line_end,
        trim(text, E' \t\r\n') AS content FROM documents WHERE trim(text, E' \t\r\n') <> ''"""
    )
)
def chunked_documents(t: Tables) -> DataFrame:
    return ch.chunk_markdown(corpus(t))


def part_table_corpus(t: Tables) -> DataFrame:
    """One small document per part: a heading path and a pipe table of two rows."""
    text = F.concat(
        F.lit("# "), F.col("p_brand"), F.lit("\n\n## "), F.col("p_type"), F.lit("\n\nAbout "), F.col("p_name"), F.lit(".\n\n| Field | Value |\n|---|---|\n| Name | "),
        F.col("p_name"), F.lit(" |\n| Size | "), F.col("p_size").cast("string"), F.lit(" | cut |\n\n### "), F.col("p_name"), F.lit("\n\nEnd."),
    )
    return t.part.select(F.col("p_partkey").alias("doc"), F.col("p_brand").alias("source"), text.alias("text"))


@query(
    """WITH d AS (SELECT p_partkey AS doc, p_brand || ' > ' || p_type AS s2, p_brand || ' > ' || p_type || ' > ' || p_name AS s3, p_name, p_size FROM part),
    h AS (SELECT '["Field","Value"]' AS th)
    SELECT doc, s2 AS section, 'paragraph_full' AS chunk_type, '' AS table_headers, 'About ' || p_name || '.' AS content, 1 AS chunk_index, 5 AS line_start FROM d
    UNION ALL SELECT doc, s2, '', '', 'About ' || p_name || '.', 1, 5 FROM d
    UNION ALL SELECT doc, s2, 'table_full', th, '| Field | Value |' || chr(10) || '|---|---|' || chr(10) || '| Name | ' || p_name || ' |' || chr(10)
        || '| Size | ' || CAST(p_size AS VARCHAR) || ' | cut |', 1, 7 FROM d, h
    UNION ALL SELECT doc, s2, 'table_row', th, '["Name","' || p_name || '"]', 0, 7 FROM d, h
    UNION ALL SELECT doc, s2, 'table_row', th, '["Size","' || CAST(p_size AS VARCHAR) || '"]', 1, 7 FROM d, h
    UNION ALL SELECT doc, s3, 'paragraph_full', '', 'End.', 1, 14 FROM d
    UNION ALL SELECT doc, s3, '', '', 'End.', 1, 14 FROM d"""
)
def chunked_tables(t: Tables) -> DataFrame:
    out = ch.chunk_markdown(part_table_corpus(t))
    return out.select("doc", "section", "chunk_type", "table_headers", "content", "chunk_index", "line_start")


@query(
    r"""WITH l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) + 1 AS line_no FROM documents),
    c AS (SELECT *, string_agg(line, chr(10)) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS before,
                 string_agg(line, chr(10)) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS after FROM l),
    x AS (SELECT doc, line_no, line, before, after, regexp_extract_all(line, '(?i)licen[sc]e[a-z]*') AS found FROM c)
    SELECT doc, line_no, unnest(range(len(found))) AS match_no, unnest(found) AS match,
        CASE WHEN before IS NULL THEN '' ELSE '    ' || replace(before, chr(10), chr(10) || '    ') || chr(10) END || '>>> ' || line
        || CASE WHEN after IS NULL THEN '' ELSE chr(10) || '    ' || replace(after, chr(10), chr(10) || '    ') END AS context
    FROM x WHERE len(found) > 0"""
)
def grep_context(t: Tables) -> DataFrame:
    return ch.grep_context(corpus(t), "licen[sc]e[a-z]*", 2).select("doc", "line_no", "match_no", "match", "context")


@query(
    r"""WITH x AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM documents)
    SELECT doc_id FROM x WHERE length(s) >= 20 AND len(regexp_extract_all(s, '[\p{L}\p{N}]')) >= 3
    AND (regexp_matches(s, '(?i)"""
    + tx.VALUABLE
    + r"""') OR len(regexp_extract_all(s, '\p{L}')) >= 0.15 * length(s))"""
)
def embeddable_documents(t: Tables) -> DataFrame:
    return ch.valid_chunks(t.documents.withColumnRenamed("text", "content")).select("doc_id")


@query(
    r"""WITH a AS (SELECT doc_id, regexp_replace(text, '(?m)^[\s|+\-=:]+$', ' ', 'g') AS s FROM documents),
    b AS (SELECT doc_id, regexp_replace(s, '[|+\r\n\t]', ' ', 'g') AS s FROM a),
    c AS (SELECT doc_id, regexp_replace(regexp_replace(s, '\b(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})/(\d{1,2})\b', '\1ꙮ\2ꙮ\3ꙮ\4ꙩ\5', 'g'),
                 '\b(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})\b', '\1ꙮ\2ꙮ\3ꙮ\4', 'g') AS s FROM b),
    d AS (SELECT doc_id, translate(regexp_replace(s, '[^\p{L}\p{N}\p{M}_\s]', ' ', 'g'), 'ꙮꙩ', './') AS s FROM c)
    SELECT doc_id, md5(trim(regexp_replace(s, ' {2,}', ' ', 'g'))) AS digest FROM d"""
)
def embedding_texts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(tx.embedding_text("text")).alias("digest"))
