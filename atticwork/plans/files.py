"""File catalogues, leads and statements over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import files as f
from ..operators import leads as ld
from ..operators import paging
from ..operators import statements as st
from .catalog import Tables, query


def listing(t: Tables) -> DataFrame:
    """Parts as files; the brand is the folder, hidden for one of them, the type tells the extension."""
    ext = F.expr("CASE p_type WHEN 'PROMO' THEN 'JPG' WHEN 'SMALL' THEN 'mp4' WHEN 'LARGE' THEN 'txt' ELSE 'png' END")
    folder = F.when(F.col("p_brand") == "Brand#3", F.lit(".cache")).otherwise(F.col("p_brand"))
    path = F.concat(F.lit("/media/"), folder, F.lit("/"), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("_"), F.col("p_partkey").cast("string"), F.lit("."), ext)
    return t.part.select(path.alias("path"), F.col("p_retailprice").cast("long").alias("size"), F.col("p_partkey").alias("mtime"), "p_type", "p_size")


_LIST = """
    x AS (SELECT CASE p_type WHEN 'PROMO' THEN 'JPG' WHEN 'SMALL' THEN 'mp4' WHEN 'LARGE' THEN 'txt' ELSE 'png' END AS ext,
                 '/media/' || CASE WHEN p_brand = 'Brand#3' THEN '.cache' ELSE p_brand END || '/' || replace(p_name, ' ', '.') || '_' || CAST(p_partkey AS VARCHAR) || '.' AS stem,
                 CAST(trunc(p_retailprice) AS BIGINT) AS size, p_partkey AS mtime, p_brand, p_type, p_size FROM part),
    files AS (SELECT *, stem || ext AS path FROM x)
"""


@query(f"WITH {_LIST} SELECT path, size FROM files WHERE ext <> 'txt' AND p_brand <> 'Brand#3' AND size BETWEEN 920 AND 1050")
def media_files(t: Tables) -> DataFrame:
    return f.select_media(listing(t), min_size=920, max_size=1050, root="/media").select("path", "size")


@query("SELECT '/' || source || '/' || doc_id AS path, CASE WHEN l.doc_id IS NULL THEN md5(text) ELSE 'cached' END AS hash FROM documents d LEFT JOIN labels l USING (doc_id)")
def hashes_with_cache(t: Tables) -> DataFrame:
    path = F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    own = t.documents.select("doc_id", path.alias("path"), F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime"))
    cache = own.join(t.labels.select("doc_id"), "doc_id").select("path", "size", "mtime", F.lit("cached").alias("hash"), F.lit("md5").alias("hash_alg"))
    contents = t.documents.select(path.alias("path"), F.encode("text", "utf-8").alias("content"))
    return f.hash_with_cache(own.drop("doc_id"), contents, cache).select("path", "hash")


@query(
    """SELECT coalesce(l.doc_id, d.doc_id) AS path, CASE WHEN l.doc_id IS NULL THEN 'old' ELSE 'new' END AS hash
    FROM documents d LEFT JOIN labels l USING (doc_id)"""
)
def upserted_cache(t: Tables) -> DataFrame:
    cache = t.documents.select(F.col("doc_id").alias("path"), F.lit("old").alias("hash"))
    return f.upsert_cache(cache, t.labels.select(F.col("doc_id").alias("path"), F.lit("new").alias("hash")))


@query("SELECT doc_id, md5(encode(text)) AS hash FROM documents")
def prefix_hashes(t: Tables) -> DataFrame:
    """Digest of the whole content; hashing a prefix only is an option of the operator."""
    return t.documents.select("doc_id", f.content_hash(F.encode("text", "utf-8")).alias("hash"))


@query(
    """SELECT d.doc_id, CASE WHEN quality = 1 THEN 1600000000 + d.doc_id ELSE 1500000000 END AS stamp
    FROM documents d JOIN labels l USING (doc_id)"""
)
def sidecar_timestamps(t: Tables) -> DataFrame:
    media = t.documents.select("doc_id", F.concat(F.lit("/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path"))
    sidecars = t.labels.select(
        F.concat(F.lit("/"), F.col("doc_id").cast("string"), F.lit(".jpg.json")).alias("path"),
        F.lit(1500000000).cast("long").alias("created"),
        F.when(F.col("quality") == 1, F.lit(1600000000) + F.col("doc_id")).otherwise(F.lit(900000000)).alias("taken"),
    )
    return f.attach_sidecar(media, sidecars).select("doc_id", f.best_timestamp("taken", "created").alias("stamp"))


@query("SELECT o_orderkey AS id, strftime(CASE WHEN o_orderstatus = 'F' THEN o_orderdate ELSE TIMESTAMP '2001-02-03 04:05:06' END, '%Y-%m-%d_%H-%M-%S') AS label FROM orders")
def time_labels(t: Tables) -> DataFrame:
    original = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss"))
    return t.orders.select(F.col("o_orderkey").alias("id"), f.time_label(original, F.lit("2001-02-03 04:05:06").cast("timestamp")).alias("label"))


@query("SELECT p_partkey AS id FROM part WHERE p_type NOT IN ('PROMO', 'SMALL')")
def rich_exif(t: Tables) -> DataFrame:
    tags = F.expr(
        "CASE p_type WHEN 'PROMO' THEN map('DateTime', 'x') WHEN 'SMALL' THEN map('Model', p_name) ELSE map('DateTimeOriginal', 'x', 'Model', p_name) END"
    )
    return t.part.filter(f.has_rich_exif(tags)).select(F.col("p_partkey").alias("id"))


def recordings(t: Tables) -> DataFrame:
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("["), F.col("p_partkey").cast("string"), F.lit("].amr"))
    return t.part.select(F.col("p_brand").alias("dir"), name.alias("name"), F.col("p_partkey").alias("mtime"))


def transcripts(t: Tables) -> DataFrame:
    """Promo parts have an empty transcript, small ones a good one, large ones both, others none."""
    stem = F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("["), F.col("p_partkey").cast("string"), F.lit("]"))
    one = lambda types, suffix, size: t.part.filter(F.col("p_type").isin(types)).select(
        F.col("p_brand").alias("dir"), F.concat(stem, F.lit(suffix)).alias("name"), F.lit(size).cast("long").alias("size")
    )
    return one(["PROMO", "LARGE"], ".model-1.0.txt", 0).unionByName(one(["SMALL", "LARGE"], ".other.txt", 9))


_STATUS = """
    s AS (SELECT p_brand AS dir, replace(p_name, ' ', '.') || '[' || CAST(p_partkey AS VARCHAR) || '].amr' AS name, p_partkey AS mtime,
                 CASE WHEN p_type IN ('SMALL', 'LARGE') THEN 'SUCCESS' WHEN p_type = 'PROMO' THEN 'FAILED' ELSE 'NOT_ATTEMPTED' END AS status FROM part)
"""


@query(f"WITH {_STATUS} SELECT dir, name, status FROM s")
def transcription_status(t: Tables) -> DataFrame:
    return f.transcription_status(recordings(t), transcripts(t)).select("dir", "name", "status")


@query(f"WITH {_STATUS} SELECT dir, name FROM s WHERE status <> 'SUCCESS'")
def work_queue(t: Tables) -> DataFrame:
    return f.work_queue(f.transcription_status(recordings(t), transcripts(t))).select("dir", "name")


@query(
    f"""WITH {_STATUS} SELECT count(*) AS found, count(*) FILTER (WHERE status = 'SUCCESS') AS skipped,
    count(*) FILTER (WHERE status <> 'SUCCESS') AS waiting, count(*) FILTER (WHERE status = 'FAILED') AS failed FROM s"""
)
def queue_stats(t: Tables) -> DataFrame:
    return f.queue_stats(f.transcription_status(recordings(t), transcripts(t)))


@query(
    """SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m') AS ym FROM orders WHERE o_orderstatus <> 'P'"""
)
def files_by_month(t: Tables) -> DataFrame:
    """Call recordings: dashes, dots, and for pending orders mixed separators, which are no date."""
    name = F.concat(
        F.lit("[+7 000 555-01-23]_"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 'O' THEN date_format(o_orderdate, 'yyyy.MM.dd') ELSE date_format(o_orderdate, 'yyyy-MM.dd') END"),
        F.lit("_10-11-12.amr"),
    )
    return f.with_month(t.orders.select(F.col("o_orderkey").alias("id"), name.alias("name"))).select("id", "ym")


# --- leads over ``pages``: the page is the lead, its length the phone ---


def requests(t: Tables) -> DataFrame:
    digits = F.concat(F.lpad(F.col("page_id").cast("string"), 4, "9"), F.length("html").cast("string"), F.col("page_id").cast("string"))
    return t.pages.select(
        F.col("page_id").alias("id"),
        F.when(F.col("url").startswith("https"), F.lit("secure")).alias("token"),
        F.concat(F.lit("+7 ("), digits, F.lit(")-x")).alias("phone"),
        F.lit("").alias("x_real_ip"),
        F.when(F.contains("url", F.lit(".net")), F.lit("10.0.0.1")).alias("x_forwarded_for"),
        F.lit("127.0.0.1").alias("remote_addr"),
        F.lit(None).cast("string").alias("user_agent"),
        F.col("url").alias("referer"),
    )


def lead_table(t: Tables) -> DataFrame:
    return ld.append_leads(requests(t), F.lit(1700000000000) + F.col("id") * 1000)


_LEADS = """
    l AS (SELECT page_id AS id, CASE WHEN url LIKE 'https%' THEN 'secure' ELSE 'UndefToken' END AS token,
        '7' || lpad(CAST(page_id AS VARCHAR), 4, '9') || CAST(length(html) AS VARCHAR) || CAST(page_id AS VARCHAR) AS phone,
        CASE WHEN contains(url, '.net') THEN '10.0.0.1' ELSE '127.0.0.1' END AS "clientIP", '' AS "userAgent", url AS referer, 'new' AS status,
        1700000000000 + page_id * 1000 AS created_at FROM pages)
"""


@query(f"WITH {_LEADS} SELECT * FROM l")
def appended_leads(t: Tables) -> DataFrame:
    return lead_table(t)


@query(f"WITH {_LEADS} SELECT id, token FROM l WHERE (contains(phone, '9113') OR contains(referer, '9113') OR contains(token, '9113')) AND created_at >= 1700000010000")
def leads_by_digits(t: Tables) -> DataFrame:
    return ld.search_leads(lead_table(t), "(91) 1-3", 1700000010000).select("id", "token")


@query(f"WITH {_LEADS} SELECT id, referer FROM l WHERE contains(lower(referer), '.net') ORDER BY token DESC, id LIMIT 10 OFFSET 20")
def lead_page(t: Tables) -> DataFrame:
    found = ld.search_leads(lead_table(t), ".NET")
    return paging.page(found.orderBy(*ld.lead_order("token:desc")), 3, 10).select("id", "referer")


_SHOW = """CASE
    WHEN n = 10 THEN '+7 (' || substring(phone, 1, 3) || ') ' || substring(phone, 4, 3) || '-' || substring(phone, 7, 2) || '-' || substring(phone, 9, 2)
    WHEN n >= 11 THEN '+' || left(phone, k) || ' (' || substring(phone, k + 1, 3) || ') ' || substring(phone, k + 4, 3) || '-' || substring(phone, k + 7, 2) || '-' || substring(phone, k + 9, 2)
    ELSE phone END"""


@query(
    f"""WITH {_LEADS}, s AS (SELECT *, length(phone) AS n, CASE WHEN length(phone) <= 12 THEN 1 WHEN length(phone) = 13 THEN 2 ELSE 3 END AS k FROM l)
    SELECT id, {_SHOW} AS phone, strftime(make_timestamp(created_at * 1000), '%Y-%m-%d %H:%M:%S') AS created_at FROM s"""
)
def shown_leads(t: Tables) -> DataFrame:
    shown = ld.show_leads(lead_table(t))
    return shown.select("id", "phone", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


# --- statements over ``orders`` ---

OWNER = {"bic": "000000001", "bank": "Test Bank", "corr_account": "30100000000000000001", "name": "Test Owner", "tax_id": "000000000001"}


def transactions(t: Tables) -> DataFrame:
    kind = F.expr("CASE o_orderstatus WHEN 'F' THEN 'DEBIT' WHEN 'O' THEN 'CREDIT' ELSE 'OTHER' END")
    sign = F.when(F.col("o_orderstatus") == "F", -1).otherwise(1)
    return t.orders.select(
        F.concat(F.lit("ACC"), F.col("o_custkey").cast("string")).alias("account_id"), kind.alias("TRNTYPE"),
        F.date_format("o_orderdate", "yyyyMMddHHmmss").alias("DTPOSTED"), (F.col("o_totalprice") * sign).cast("decimal(18,4)").alias("TRNAMT"),
        F.col("o_orderkey").cast("string").alias("CHECKNUM"), F.col("o_orderpriority").alias("NAME"),
    )


def _party_sql(side: str) -> str:
    lines = [f"{side}БИК={OWNER['bic']}", f"{side}Банк1={OWNER['bank']}", f"{side}Корсчет={OWNER['corr_account']}", f"{side}1={OWNER['name']}", f"{side}ИНН={OWNER['tax_id']}"]
    return " || chr(10) || ".join(f"'{x}'" for x in lines) + f" || chr(10) || '{side}Счет=ACC' || CAST(o_custkey AS VARCHAR) || chr(10)"


@query(
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS "CHECKNUM", 'СекцияДокумент=Платежное поручение' || chr(10) || 'Номер=' || CAST(o_orderkey AS VARCHAR) || chr(10)
    || 'НазначениеПлатежа=' || o_orderpriority || chr(10) || 'Дата=' || strftime(o_orderdate, '%d.%m.%Y') || chr(10)
    || 'Сумма=' || regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(18, 4)) AS VARCHAR), '\\.?0+$', '') || chr(10)
    || CASE o_orderstatus WHEN 'F' THEN {_party_sql("Плательщик")} WHEN 'O' THEN {_party_sql("Получатель")} ELSE '' END || 'КонецДокумента' AS record FROM orders"""
)
def exchange_records(t: Tables) -> DataFrame:
    return st.to_exchange(transactions(t), OWNER).select("CHECKNUM", "record")


@query(
    """SELECT DISTINCT 'ACC' || CAST(o_custkey AS VARCHAR) AS account_id, '1CClientBankExchange' || chr(10) || 'ВерсияФормата=1.03' || chr(10) || 'Кодировка=Windows'
    || chr(10) || 'Отправитель=A' || chr(10) || 'Получатель=B' || chr(10) || 'РасчСчет=ACC' || CAST(o_custkey AS VARCHAR) || chr(10) || 'СекцияРасчСчет' || chr(10)
    || 'РасчСчет=ACC' || CAST(o_custkey AS VARCHAR) || chr(10) || 'КонецРасчСчет' AS record FROM orders"""
)
def exchange_headers(t: Tables) -> DataFrame:
    return st.exchange_header(transactions(t), "A", "B")


# --- scalar text rules over ``part`` and ``pages`` ---


@query(
    """SELECT p_partkey AS id, lower(replace(p_name, ' ', '_')) AS file_title, printf('%04d', p_size) || '_' || lower(replace(p_name, ' ', '_')) AS file_name,
    p_size AS trailing FROM part"""
)
def title_rules(t: Tables) -> DataFrame:
    padded = F.concat(F.lit("  "), "p_name", F.lit("!? - "))
    titled = F.concat(F.col("p_name"), F.lit(" - "), F.col("p_size").cast("string"))
    return t.part.select(
        F.col("p_partkey").alias("id"), tx.file_title(padded).alias("file_title"),
        tx.numbered_file_title(F.col("p_name"), F.col("p_size")).alias("file_name"), tx.trailing_number(titled).alias("trailing"),
    )


@query(
    r"""SELECT page_id AS id, url || ' plain ' || url AS clean FROM pages"""
)
def cleaned_links(t: Tables) -> DataFrame:
    text = F.concat(F.lit("["), "url", F.lit("](#_Ref1) plain "), F.lit("["), "url", F.lit("](http://x/y){#id .c} (#_Toc9)"))
    return t.pages.select(F.col("page_id").alias("id"), tx.markdown_clean(text).alias("clean"))
