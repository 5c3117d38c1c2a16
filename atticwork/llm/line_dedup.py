"""Line dedup: lines that many documents share stay only in the document with the largest id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, written

MIN_CHARS = 20
MIN_DOCS = 3


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _text_mark(text: Column) -> Column:
    """Tells the texts of rows with the same id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, bits): per text a bit for each place up to the last line that it loses, 64 places to a number.

    A line's digest, two 64-bit hashes, is counted once per document before the shuffle; a line that a third of all
    documents hold is a few partial counts per task. The lookup joins two written tables, so that a hot digest is split.
    """
    text = F.col(text_col)
    # The mark is made before the lines are, else it would be made for every line.
    texts = docs.select(F.col(id_col).alias("doc_id"), _text_mark(text).alias("mark"), text.alias("text"))
    lines = texts.select("doc_id", "mark", F.posexplode(_lines(F.col("text"))).alias("place", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    held = written(
        keyed.select("doc_id", "mark", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2")), "line-digests"
    )
    counts = (
        held.select("doc_id", "h1", "h2").distinct()
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("docs") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    counts = written(counts, "line-counts")
    lost = held.join(counts, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    words = lost.groupBy("doc_id", "mark", F.floor(F.col("place") / 64).cast("int").alias("number")).agg(
        F.bit_or(F.expr("shiftleft(1L, place % 64)")).alias("bits")
    )
    gone = written(words.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_list(F.struct("number", "bits"))).alias("gone")), "line-places")
    # Computed here and joined as a column: an expression would be computed anew for every line that looks into it.
    return gone.select("doc_id", "mark", _every_word(F.col("gone")).alias("bits"))


def _every_word(gone: Column) -> Column:
    """The bits of all numbers from 0 to the last one in an array, so that a place is looked up at once."""
    def filled(w: Column, k: Column) -> Column:
        before = F.coalesce(F.get(gone, k - 1)["number"], F.lit(-1))
        return F.concat(F.array_repeat(F.lit(0).cast("long"), w["number"] - before - 1), F.array(w["bits"]))

    return F.flatten(F.transform(gone, filled))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs with the kept text in text_col, plus n_lines (before dropping) and n_dropped.

    A text is split at \\n; null and empty texts are one empty line, and the kept text of a null is empty.
    A line's key is the line without white space at both ends, A-Z in lower case. Keys of at least min_chars
    code points held by at least min_docs distinct documents lose every line except those of the largest
    document id that holds them (all its repeats stay). Rows with the same id count as one document and are
    treated alike; a null id is one document and the smallest. Other columns pass through, whatever their
    names. An empty table gives an empty table. The work is linear in the lines of a text.
    """
    names = docs.columns
    body = docs.select(F.struct(*[docs[n] for n in names]).alias("row"), docs[id_col].alias("doc_id"), _text_mark(docs[text_col]).alias("mark"))
    drops = repeated_lines(docs, min_chars, min_docs, id_col, text_col).withColumnsRenamed({"doc_id": "drop_id", "mark": "drop_mark"})
    # The places are hashed and the texts pass by: they need not be sorted, at any size.
    body = body.join(drops.hint("shuffle_hash"), body["doc_id"].eqNullSafe(drops["drop_id"]) & (body["mark"] == drops["drop_mark"]), "left")
    goes = lambda i: F.getbit(F.get("bits", F.floor(i / 64).cast("int")), (i % 64).cast("int")) == 1
    kept = F.filter("lines", lambda line, i: ~F.coalesce(goes(i), F.lit(False)))
    # Documents that lose nothing skip the per-line test.
    return (
        body.select("row", _lines(F.col("row").getField(text_col)).alias("lines"), "bits")
        .withColumn("kept", F.when(F.col("bits").isNull(), F.col("lines")).otherwise(kept))
        .select(
            *[
                (F.array_join("kept", "\n") if n == text_col else F.col("row").getField(n)).alias(n)
                for n in names
            ],
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        )
    )


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), hot AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), flagged AS (
  SELECT keyed.*, (hot.k IS NOT NULL AND keyed.doc_id <> hot.keeper) AS dropped FROM keyed LEFT JOIN hot USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""


def query(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )
