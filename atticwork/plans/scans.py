"""Readers and writers of files: the driver tables are written in a foreign form and read back by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import registry
from ..operators import books as b
from ..operators import nearest
from ..operators import statements as st
from ..session import shared_dir
from ..sources import books as book_source
from ..sources import corpus, files, statements
from ..streaming import events as s
from .camera import messages
from .catalog import Tables, query
from .files import OWNER, transactions
from .search import chunks


def _markdown_files(t: Tables) -> str:
    """One Markdown file per supplier: a heading, a paragraph and a table."""
    folder = shared_dir(t.spark, "markdown")
    text = F.concat(
        F.lit("# "), F.col("s_name"), F.lit("\n\nBalance of the account "), F.col("s_acctbal").cast("string"),
        F.lit(" as reported.\n\n| Field | Value |\n|---|---|\n| nation | "), F.col("s_nationkey").cast("string"), F.lit(" |"),
    )
    files.write_small_files(t.supplier.select(F.col("s_suppkey"), text.alias("value")), "s_suppkey", "value", folder, "txt")
    return folder


def _corpus(t: Tables) -> DataFrame:
    read = corpus.read_corpus(t.spark, _markdown_files(t), "*.txt")
    return read.withColumn("source", F.regexp_extract("doc", r"s_suppkey=(\d+)", 1))


_REPORT = "'Balance of the account ' || CAST(s_acctbal AS VARCHAR) || ' as reported.'"


@query(
    f"""SELECT CAST(s_suppkey AS VARCHAR) AS source, '# ' || s_name || chr(10) || chr(10) || {_REPORT} || chr(10) || chr(10)
    || '| Field | Value |' || chr(10) || '|---|---|' || chr(10) || '| nation | ' || CAST(s_nationkey AS VARCHAR) || ' |' || chr(10) AS text FROM supplier"""
)
def scanned_corpus(t: Tables) -> DataFrame:
    return _corpus(t).select("source", "text")


@query(
    f"""WITH d AS (SELECT CAST(s_suppkey AS VARCHAR) AS source, s_name AS section, {_REPORT} AS prose, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier),
    c AS (SELECT source, section, 'paragraph_full' AS chunk_type, prose AS content FROM d
        UNION ALL SELECT source, section, '', prose FROM d
        UNION ALL SELECT source, section, 'table_full', '| Field | Value |' || chr(10) || '|---|---|' || chr(10) || '| nation | ' || nation || ' |' FROM d)
    SELECT source, section, chunk_type, content, 2 AS copies, 26 AS dims FROM c"""
)
def indexed_corpus(t: Tables) -> DataFrame:
    """The corpus is read, cut, embedded and written as the chunk table, and its chunks are appended once more."""
    name = f"kb_{uuid.uuid4().hex}"

    def letters(texts: list[str]) -> list[list[float]]:
        return [[float(text.lower().count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for text in texts]

    corpus.reindex(t.spark, _corpus(t), name, letters, nearest.letter_vector)
    corpus.write_chunks(t.spark.table(name).drop("id"), name)
    return t.spark.table(name).groupBy("source", "section", "chunk_type", "content").agg(
        F.count_distinct("id").cast("int").alias("copies"), F.max(F.size("embedding")).alias("dims")
    )


@query(
    """SELECT 'ev' || CAST(event_id AS VARCHAR) AS clip, 'cam' || CAST(user_id % 7 AS VARCHAR) AS camera, CASE event_type WHEN 'click' THEN 'car' ELSE 'dog' END AS labels
    FROM events WHERE event_type IN ('click', 'view') AND value > 20"""
)
def streamed_messages(t: Tables) -> DataFrame:
    """Messages arrive as lines of text files."""
    folder = shared_dir(t.spark, "messages")
    messages(t).select(F.col("data").alias("value")).write.text(folder)
    out = s.run_available(s.filter_events(s.event_stream(t.spark, folder), ["car", "dog"]), "from-text")
    return out.select(F.replace("clip_id", F.lit("before-"), F.lit("")).alias("clip"), "camera", "labels")


@query(
    """SELECT 'ACC' || CAST(o_custkey AS VARCHAR) AS account_id, CAST(o_orderkey AS VARCHAR) AS "CHECKNUM", strftime(o_orderdate, '%Y%m%d') AS "DTPOSTED",
    CAST(CAST(o_totalprice AS DECIMAL(18, 4)) AS DOUBLE) AS amount,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS position FROM orders"""
)
def scanned_statements(t: Tables) -> DataFrame:
    """Orders as bank statements in XML, one per customer."""
    entry = F.struct(
        F.col("o_orderkey").alias("_key"), F.lit("DEBIT").alias("TRNTYPE"), F.date_format("o_orderdate", "yyyyMMdd").alias("DTPOSTED"),
        F.col("o_totalprice").cast("decimal(18,4)").alias("TRNAMT"), F.col("o_orderkey").cast("string").alias("CHECKNUM"), F.lit("A & B <c>").alias("NAME"),
    )
    owned = t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(entry)).alias("all"))
    plain = F.transform("all", lambda e: e.dropFields("_key"))
    folder = shared_dir(t.spark, "statements")
    owned.select(
        F.struct(F.concat(F.lit("ACC"), F.col("o_custkey").cast("string")).alias("ACCTID")).alias("BANKACCTFROM"), F.struct(plain.alias("STMTTRN")).alias("BANKTRANLIST")
    ).write.format("xml").option("rowTag", "STMTRS").save(folder)
    found = statements.read_statements(t.spark, folder)
    return found.select("account_id", "CHECKNUM", "DTPOSTED", F.col("TRNAMT").cast("double").alias("amount"), F.col("position").cast("long").alias("position"))


@query(
    """WITH r AS (SELECT 'ACC' || CAST(o_custkey % 40 AS VARCHAR) AS account_id, count(*) AS documents, count(*) FILTER (WHERE o_orderstatus = 'F') AS paid FROM orders GROUP BY 1)
    SELECT account_id, documents, paid, 1 AS headers FROM r"""
)
def written_exchange(t: Tables) -> DataFrame:
    """Exchange files of forty accounts in the Windows code page, read back and counted by kind of line."""
    folder = shared_dir(t.spark, "exchange")
    number = F.substr("account_id", F.lit(4)).cast("long") % 40
    own = transactions(t).withColumn("account_id", F.concat(F.lit("ACC"), number.cast("string")))
    st.write_exchange(own, OWNER, "A", "B", folder, ["CHECKNUM"], windows=True)
    lines = t.spark.read.text(folder).withColumn("value", st.from_windows_1251(F.col("value")))
    own = F.concat(F.lit("ПлательщикСчет="), F.col("account_id"))
    return lines.groupBy("account_id").agg(
        F.count_if(F.col("value") == st.RECORD_END).alias("documents"), F.count_if(F.col("value") == own).alias("paid"),
        F.count_if(F.col("value") == st.HEADER[0]).cast("int").alias("headers"),
    )


@query("SELECT source, CAST(33 * count(*) AS BIGINT) AS size FROM documents GROUP BY source")
def listed_media(t: Tables) -> DataFrame:
    """One file with the extension of pictures per source, a line of 32 signs for every document."""
    folder = shared_dir(t.spark, "media")
    rows = t.documents.select("source", F.md5("text").alias("line")).repartition("source")
    rows.write.option("extension", "jpg").partitionBy("source").csv(folder)
    found = files.list_media(t.spark, [folder], min_size=1)
    named = found.select(F.url_decode(F.regexp_extract("path", "source=([^/]*)/", 1)).alias("source"), "size")
    return named.groupBy("source").agg(F.sum("size").alias("size"))


@query(
    """SELECT s_suppkey AS id, 1700000000 + s_suppkey AS created, CASE WHEN s_nationkey % 2 = 0 THEN 1600000000 + s_suppkey END AS taken FROM supplier"""
)
def scanned_sidecars(t: Tables) -> DataFrame:
    """One JSON file per supplier with two nested times, one of them not always there."""
    stamp = lambda base: F.struct((F.lit(base) + F.col("s_suppkey")).cast("string").alias("timestamp"))
    taken = F.when(F.col("s_nationkey") % 2 == 0, F.struct(F.struct(F.lit("x").alias("y")).alias("a"), stamp(1_600_000_000).alias("photoTakenTime")))
    rows = t.supplier.select("s_suppkey", stamp(1_700_000_000).alias("creationTime"), taken.alias("more"))
    folder = shared_dir(t.spark, "sidecars")
    own = rows.select("s_suppkey", F.to_json(F.struct("creationTime", "more")).alias("value"))
    files.write_small_files(own, "s_suppkey", "value", folder, "json")
    found = files.read_sidecars(t.spark, folder)
    return found.select(F.regexp_extract("path", r"s_suppkey=(\d+)", 1).cast("long").alias("id"), "created", "taken")


@query(
    """SELECT 'exact_search' AS name, count(*) AS hits FROM documents WHERE contains(lower(text), 'mail')
    UNION ALL SELECT 'list_sources', count(DISTINCT source) FROM documents
    UNION ALL SELECT 'regex_search', sum(len(regexp_extract_all(text, '\\d{4}'))) FROM documents
    UNION ALL SELECT 'get_chunks_by_index', count(*) FROM documents WHERE source = 'src5' AND lang = 'en' AND doc_id IN (5, 25)"""
)
def called_by_name(t: Tables) -> DataFrame:
    """Operators of the registry, called by name with checked arguments."""
    own = chunks(t)
    calls = {
        "exact_search": {"query": "mail"}, "list_sources": {}, "regex_search": {"pattern": r"\d{4}"},
        "get_chunks_by_index": {"source": "src5", "section": "en", "indices": [5, 25]},
    }
    parts = [registry.call(name, own, **args).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("hits")) for name, args in calls.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    """SELECT p_partkey AS id, p_brand || ' - ' || p_type || ' - ' || p_name AS title, 'Size ' || CAST(p_size AS VARCHAR) || chr(10) || 'of ' || p_name AS content FROM part"""
)
def scanned_books(t: Tables) -> DataFrame:
    """Parts as books in XML, several in a file, with sections three levels deep."""
    titled = lambda c: F.struct(F.col(c).alias("p")).alias("title")
    paragraphs = F.array(F.concat(F.lit(" Size "), F.col("p_size").cast("string")), F.concat(F.lit("of "), F.col("p_name"), F.lit(" "))).alias("p")
    inner = F.struct(titled("p_name"), paragraphs).alias("section")
    outer = F.struct(titled("p_brand"), F.struct(titled("p_type"), inner).alias("section")).alias("section")
    book = F.struct(F.struct(F.col("p_partkey").cast("string").alias("book-title")).alias("title-info")).alias("description")
    folder = shared_dir(t.spark, "books")
    t.part.select(book, F.struct(outer).alias("body")).write.format("xml").option("rowTag", "FictionBook").save(folder)
    leaves = b.flatten_sections(book_source.scan_books(t.spark, folder, depth=4))
    return leaves.select(F.col("book").cast("long").alias("id"), "title", "content")
