"""Transcripts over ``conversations``: a conversation is a recording, a turn a block of 60 seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import transcripts as tr
from .catalog import Tables, query


def blocks(t: Tables) -> DataFrame:
    """Turns as blocks; conversations with a system message speak twice as slowly."""
    return t.conversations.select(
        F.col("conv_id").alias("file"), F.col("turn").alias("id"), (F.col("turn") * 60).cast("double").alias("start_sec"),
        F.col("role").alias("speaker"), "text",
    )


def sentences(t: Tables) -> DataFrame:
    """Sentences of all turns with times spread over 50 seconds from the start of the turn."""
    split = t.conversations.select(
        F.col("conv_id").alias("file"), "turn", F.posexplode(tx.sentences("text")).alias("no", "text")
    ).withColumn("piece_start", (F.col("turn") * 60).cast("double")).withColumn("piece_seconds", F.lit(50.0))
    timed = tr.spread_timestamps(split, ["file", "turn"], ["no"], "piece_start", "piece_seconds")
    return timed.withColumn("id", F.col("turn") * 100000 + F.col("no"))


_SENT = r"""
    raw AS (SELECT conv_id AS file, turn, string_split(regexp_replace(trim(text, E' \t\n\r'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts
            FROM conversations),
    ex AS (SELECT file, turn, unnest(parts) AS text, unnest(range(len(parts))) AS no FROM raw),
    se AS (SELECT file, turn, row_number() OVER (PARTITION BY file, turn ORDER BY no) - 1 AS no, trim(text, E' \t\n\r') AS text FROM ex
           WHERE trim(text, E' \t\n\r') <> ''),
    su AS (SELECT *, length(text) AS len, sum(length(text)) OVER (PARTITION BY file, turn ORDER BY no) AS upto,
                  sum(length(text)) OVER (PARTITION BY file, turn) AS total FROM se),
    s AS (SELECT file, turn * 100000 + no AS id, turn, text, turn * 60.0::DOUBLE + 50.0::DOUBLE * (upto - len) / total AS start,
                 turn * 60.0::DOUBLE + 50.0::DOUBLE * upto / total AS end_ FROM su)
"""


@query(f'WITH {_SENT} SELECT file, id, text, round(start, 3) AS start, round(end_, 3) AS "end" FROM s')
def sentence_times(t: Tables) -> DataFrame:
    return sentences(t).select("file", "id", "text", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query(
    rf"""WITH {_SENT},
    w AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY start, id) AS pos,
                 list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS words FROM s),
    d AS (SELECT DISTINCT a.file, a.id FROM w a JOIN w b ON a.file = b.file AND b.pos > a.pos
          AND b.start <= a.start + 2 * 40 AND len(list_intersect(a.words, b.words)) * 1.0
              / (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))) > 0.8)
    SELECT file, id FROM s WHERE (file, id) NOT IN (SELECT (file, id) FROM d)"""
)
def sentences_without_copies(t: Tables) -> DataFrame:
    return tr.dedupe_overlap(sentences(t), 40.0).select("file", "id")


@query(
    f"""WITH {_SENT},
    g AS (SELECT *, lag(end_) OVER (PARTITION BY file ORDER BY start, id) AS prev FROM s),
    f AS (SELECT *, CASE WHEN prev IS NOT NULL AND start - prev < 5 THEN 0 ELSE 1 END AS is_new FROM g),
    b AS (SELECT *, sum(is_new) OVER (PARTITION BY file ORDER BY start, id ROWS UNBOUNDED PRECEDING) AS block FROM f)
    SELECT file, block, round(min(start), 3) AS start_sec, count(*) AS sentences, string_agg(text, chr(10) ORDER BY start, id) AS text
    FROM b GROUP BY file, block"""
)
def pause_blocks(t: Tables) -> DataFrame:
    out = tr.pause_blocks(sentences(t), 5.0)
    return out.select("file", "block", F.round("start_sec", 3).alias("start_sec"), "sentences", "text")


_TURNS = r"""
    b AS (SELECT conv_id AS file, turn AS id, turn * 60.0::DOUBLE AS start_sec, role AS speaker, text,
                 len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words FROM conversations),
    g AS (SELECT *, lag(speaker) OVER w AS ps, lag(start_sec + words / 150.0 * 60) OVER w AS pe FROM b WINDOW w AS (PARTITION BY file ORDER BY start_sec, id)),
    n AS (SELECT *, sum(CASE WHEN ps IS NOT NULL AND ps = speaker AND start_sec - pe < {pause} THEN 0 ELSE 1 END)
                 OVER (PARTITION BY file ORDER BY start_sec, id ROWS UNBOUNDED PRECEDING) AS turn FROM g)
"""


@query(
    f"""WITH {_TURNS.format(pause='30')} SELECT file, turn, 0 AS part, min(start_sec) AS start_sec, min(speaker) AS speaker, count(*) AS blocks,
    string_agg(text, ' ' ORDER BY start_sec, id) AS text FROM n GROUP BY file, turn"""
)
def speaker_turns(t: Tables) -> DataFrame:
    return tr.speaker_turns(blocks(t), 30.0)


_MERGED = _TURNS.replace("role AS speaker", "CASE WHEN role = 'system' THEN 'user' ELSE role END AS speaker")


@query(f"WITH {_MERGED.format(pause='55')} SELECT file, turn, min(start_sec) AS start_sec, count(*) AS blocks FROM n GROUP BY file, turn")
def turns_with_narrator(t: Tables) -> DataFrame:
    own = blocks(t).withColumn("speaker", F.when(F.col("speaker") == "system", "user").otherwise(F.col("speaker")))
    return tr.speaker_turns(own, 55.0).select("file", "turn", "start_sec", "blocks")


@query(
    """SELECT conv_id AS file, turn AS id, '[' || lpad(CAST(turn * 60 // 3600 AS VARCHAR), 2, '0') || ':'
    || lpad(CAST(turn * 60 % 3600 // 60 AS VARCHAR), 2, '0') || ':00] ' || text AS line FROM conversations"""
)
def timed_lines(t: Tables) -> DataFrame:
    return tr.timed_lines(blocks(t)).select("file", "id", "line")


NAMES = ["Heron", "Otter"]


@query(
    """WITH i AS (SELECT DISTINCT conv_id AS file, role AS speaker FROM conversations),
    r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY speaker) AS n FROM i),
    d AS (SELECT *, CASE WHEN md5('0:' || file || ':Heron') < md5('0:' || file || ':Otter') THEN ['Heron', 'Otter'] ELSE ['Otter', 'Heron'] END AS names FROM r)
    SELECT file, speaker, names[(n - 1) % 2 + 1] || CASE WHEN n > 2 THEN '-' || CAST((n - 1) // 2 + 1 AS VARCHAR) ELSE '' END AS display_name FROM d"""
)
def speaker_names(t: Tables) -> DataFrame:
    return tr.speaker_names(blocks(t), NAMES)


@query(
    """WITH d AS (SELECT doc_id, n_chars / 10.0::DOUBLE AS total FROM documents),
    w AS (SELECT doc_id, total, unnest(range(0, CAST(total // 25 AS BIGINT) + 2)) AS window_no FROM d)
    SELECT doc_id, window_no, window_no * 25.0::DOUBLE AS start_sec, round(least(window_no * 25.0 + 30, total), 3) AS end_sec
    FROM w WHERE window_no * 25.0 + 5 <= total"""
)
def window_bounds(t: Tables) -> DataFrame:
    own = t.documents.select("doc_id", (F.col("n_chars") / 10).alias("total"))
    return tr.window_bounds(own, "total", 30.0, 5.0).select("doc_id", "window_no", "start_sec", F.round("end_sec", 3).alias("end_sec"))
