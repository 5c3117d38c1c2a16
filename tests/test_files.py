import datetime as dt
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from atticwork.functions import text
from atticwork.operators import files, leads, statements
from atticwork.sources import corpus, tables
from atticwork.sources import files as file_sources
from atticwork.sources import statements as statement_source

OWNER = {"bic": "000000001", "bank": "Test Bank", "corr_account": "301", "name": "Test Owner", "tax_id": "0001"}


def write(path, data=b"x"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_media_listing(spark, tmp_path):
    for name in ("a.JPG", "sub/b.mp4", "c.txt", ".hid.jpg", ".h/d.png", "sub/e.x.gif"):
        write(tmp_path / name, b"12345")
    write(tmp_path / "big.png", b"1" * 50)
    base = lambda df: sorted(os.path.basename(r.path) for r in df.collect())
    assert base(file_sources.list_media(spark, [str(tmp_path)])) == ["a.JPG", "b.mp4", "big.png", "e.x.gif"]
    assert base(file_sources.list_media(spark, [str(tmp_path)], min_size=10)) == ["big.png"]
    assert base(file_sources.list_media(spark, [str(tmp_path / "sub"), str(tmp_path)], max_size=10)).count("a.JPG") == 1
    listing = spark.createDataFrame([("/r/.c/a.jpg", 1), ("/r/.b.jpg", 1), ("/r/c.jpg", 1)], "path string, size long")
    assert base(files.select_media(listing, root="/r")) == ["c.jpg"]
    assert base(files.select_media(listing.filter("path like '/r/.c%'"), root="/r/.c")) == ["a.jpg"]
    assert base(files.select_media(listing, skip_hidden=False)) == [".b.jpg", "a.jpg", "c.jpg"]
    plan = file_sources.list_media(spark, [str(tmp_path)])._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_prefix_hash_may_collide_whole_hash_not(spark, tmp_path):
    write(tmp_path / "a.jpg", b"h" * 70000 + b"1")
    write(tmp_path / "b.jpg", b"h" * 70000 + b"2")
    content = file_sources.read_contents(spark, [str(tmp_path)])
    assert content.select(files.content_hash("content")).distinct().count() == 2
    prefix = content.select(files.content_hash("content", 65536).alias("h")).distinct().collect()
    assert [r.h for r in prefix] == [hashlib.md5(b"h" * 65536).hexdigest()]


def test_cache_hits_need_all_four_to_agree(spark):
    listing = spark.createDataFrame([("a", 1, 10), ("b", 1, 10), ("c", 1, 11)], "path string, size long, mtime long")
    cache = spark.createDataFrame(
        [("a", 1, 10, "ca", "md5"), ("b", 1, 10, "cb", "sha1"), ("c", 1, 10, "cc", "md5"), ("gone", 1, 1, "g", "md5")],
        "path string, size long, mtime long, hash string, hash_alg string",
    )
    contents = spark.createDataFrame([(p, bytearray(p.encode())) for p in "abc"], "path string, content binary")
    got = files.hash_with_cache(listing, contents, cache)
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    assert {r.path: r.hash for r in got.collect()} == {"a": "ca", "b": md5("b"), "c": md5("c")}
    merged = files.upsert_cache(cache, got)
    assert {r.path: r.hash for r in merged.collect()} == {"a": "ca", "b": md5("b"), "c": md5("c"), "gone": "g"}


def test_sidecars(spark, tmp_path):
    write(tmp_path / "a.jpg.json", '{"x": {"creationTime": {"timestamp": "100"}}, "photoTakenTime": {"formatted": "?", "timestamp": "1000000000"}}')
    write(tmp_path / "b.jpg.json", '{"creationTime": {"timestamp": "100"}, "photoTakenTime": {"timestamp": "930063138"}}')
    write(tmp_path / "c.jpg.json", "{}")
    side = file_sources.read_sidecars(spark, str(tmp_path))
    media = spark.createDataFrame([(f"file:{tmp_path}/{n}.jpg",) for n in "abcd"], "path string")
    joined = files.attach_sidecar(media, side.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/")))
    got = {os.path.basename(r.path): r.t for r in joined.select("path", files.best_timestamp("taken", "created").alias("t")).collect()}
    assert got == {"a.jpg": 1000000000, "b.jpg": 100, "c.jpg": None}


def test_exif_rules(spark):
    df = spark.createDataFrame([({"DateTime": "1"},), ({"Model": "m"},), ({"Model": "m", "CreateDate": "1"},), (None,)], "e map<string,string>")
    assert [r.x for r in df.select(files.has_rich_exif("e").alias("x")).collect()] == [False, False, True, False]
    label = files.time_label(F.lit("2020:01:02 03:04:05"), F.lit("2001-01-01").cast("timestamp"))
    broken = files.time_label(F.lit("no date"), F.lit("2001-01-01").cast("timestamp"))
    assert tuple(spark.range(1).select(label, broken).first()) == ("2020-01-02_03-04-05", "2001-01-01_00-00-00")


def test_transcription_status(spark):
    media = spark.createDataFrame([("d", n, 1) for n in ("a.b[1].amr", "a.amr", "x.mp4", "y.mp3", "noext")], "dir string, name string, mtime int")
    out = [("d", "a.b[1].m-1.0.txt", 5), ("d", "x.m.txt", 0), ("d", "x.n.txt", 0), ("d", "y.m.log", 9), ("e", "y.m.txt", 9), ("d", "noext.txt", 0)]
    outputs = spark.createDataFrame(out, "dir string, name string, size long")
    got = {r.name: r.status for r in files.transcription_status(media, outputs).collect()}
    # The transcript of a.b[1] also starts with "a.", which is how the name rule works.
    assert got == {"a.b[1].amr": "SUCCESS", "a.amr": "SUCCESS", "x.mp4": "FAILED", "y.mp3": "NOT_ATTEMPTED", "noext": "FAILED"}
    stats = files.queue_stats(files.transcription_status(media, outputs)).first()
    assert tuple(stats) == (5, 2, 3, 2)


@pytest.mark.parametrize(
    "name, month",
    [
        ("rec_2024-03-05_10-11-12.amr", "2024-03"), ("x_2024.03.05-1.amr", "2024-03"), ("rec_2024-03.05.amr", None),
        ("[+7 000 555-01-23]_2020-01-02.amr", "2020-01"), ("_1980-01-02", None), ("_2024-13-01", None), ("_2099-01-01", None),
    ],
)
def test_month_of_file(spark, name, month):
    assert spark.range(1).select(text.file_month(F.lit(name), F.lit(2026)).alias("m")).first().m == month


def test_month_folders(spark, tmp_path):
    df = spark.createDataFrame([("a_2024-03-05.amr",), ("b_2024-04-05.amr",), ("none.amr",)], "name string")
    files.write_by_month(df, str(tmp_path / "out"))
    assert sorted(d for d in os.listdir(tmp_path / "out") if "=" in d) == ["ym=2024-03", "ym=2024-04"]


@pytest.mark.parametrize(
    "digits, shown",
    [
        ("1234567", "1234567"), ("9161234567", "+7 (916) 123-45-67"), ("79161234567", "+7 (916) 123-45-67"),
        ("791612345678", "+7 (916) 123-45-67"), ("3809161234567", "+38 (091) 612-34-56"), ("12345678901234", "+123 (456) 789-01-23"),
        ("phone=UNDEFINED", "phone=UNDEFINED"), ("", ""),
    ],
)
def test_phone_display(spark, digits, shown):
    assert spark.range(1).select(text.phone_display(F.lit(digits)).alias("p")).first().p == shown


def test_leads(spark):
    rows = [
        (1, None, "+7 (916) 123", "", "1.1.1.1", "2.2.2.2", None, None), (2, "t", None, "1", "1", "1", "", ""),
        (3, "T3", "555", "9.9.9.9", None, None, "Агент", "Ref"),
    ]
    req = spark.createDataFrame(
        rows, "id long, token string, phone string, x_real_ip string, x_forwarded_for string, remote_addr string, user_agent string, referer string"
    )
    table = leads.append_leads(req, F.lit(1000) + F.col("id"))
    got = {r.id: r for r in table.collect()}
    assert set(got) == {1, 3} and got[1].phone == "7916123" and got[1].clientIP == "1.1.1.1"
    assert (got[1].token, got[1].status, got[1].userAgent) == ("UndefToken", "new", "")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(leads.search_leads(table, "916-12")) == [1]
    assert ids(leads.search_leads(table, "агент")) == [3]
    assert ids(leads.search_leads(table, "55")) == [3]
    assert ids(leads.search_leads(table, None, 1003)) == [3]
    assert [r.id for r in table.orderBy(*leads.lead_order("nope:desc")).collect()] == [3, 1]
    assert [r.id for r in table.orderBy(*leads.lead_order("token")).collect()] == [3, 1]


STATEMENT = """<?xml version="1.0" encoding="UTF-8"?>
<OFX><BANKMSGSRSV1><STMTTRNRS><STMTRS><BANKACCTFROM><ACCTID>{acc}</ACCTID></BANKACCTFROM><BANKTRANLIST>
<STMTTRN><TRNTYPE>DEBIT</TRNTYPE><DTPOSTED>20210305101500</DTPOSTED><TRNAMT>-17.2500</TRNAMT><FITID>1</FITID><CHECKNUM>11</CHECKNUM><NAME>Билет</NAME></STMTTRN>
<STMTTRN><TRNTYPE>CREDIT</TRNTYPE><DTPOSTED>20210302093000</DTPOSTED><TRNAMT>43.1000</TRNAMT><FITID>2</FITID><CHECKNUM>12</CHECKNUM><NAME>Back</NAME></STMTTRN>
<STMTTRN><TRNTYPE>FEE</TRNTYPE><DTPOSTED>20210302093000</DTPOSTED><TRNAMT>100.0000</TRNAMT><FITID>3</FITID><NAME>Fee</NAME></STMTTRN>
</BANKTRANLIST></STMTRS></STMTTRNRS></BANKMSGSRSV1></OFX>"""


def test_statement_to_exchange_files(spark, tmp_path):
    write(tmp_path / "in" / "1.xml", STATEMENT.format(acc="A1"))
    write(tmp_path / "in" / "2.xml", STATEMENT.format(acc="A2"))
    rows = statement_source.read_statements(spark, str(tmp_path / "in"))
    assert rows.count() == 6 and rows.schema["TRNAMT"].dataType.simpleString() == "decimal(18,4)"
    records = {(r.account_id, r.position): r.record for r in statements.to_exchange(rows, OWNER).collect()}
    assert records[("A1", 0)].split("\n") == [
        "СекцияДокумент=Платежное поручение", "Номер=11", "НазначениеПлатежа=Билет", "Дата=05.03.2021", "Сумма=17.25",
        "ПлательщикБИК=000000001", "ПлательщикБанк1=Test Bank", "ПлательщикКорсчет=301", "Плательщик1=Test Owner", "ПлательщикИНН=0001",
        "ПлательщикСчет=A1", "КонецДокумента",
    ]
    assert "Сумма=43.1\nПолучательБИК" in records[("A2", 1)] and "Сумма=100\nКонецДокумента" in records[("A2", 2)]
    out = tmp_path / "out"
    statements.write_exchange(rows, OWNER, "Us", "Them", str(out), ["position"])
    for acc in ("A1", "A2"):
        folder = out / f"account_id={acc}"
        body = "".join((folder / n).read_text(encoding="utf-8") for n in sorted(os.listdir(folder)) if n.startswith("part-"))
        assert body.startswith("1CClientBankExchange\nВерсияФормата=1.03\nКодировка=Windows\nОтправитель=Us\nПолучатель=Them\n")
        assert [line for line in body.split("\n") if line.startswith("Номер=")] == ["Номер=11", "Номер=12", "Номер="]


def test_exchange_in_the_windows_code_page(spark, tmp_path):
    write(tmp_path / "in" / "1.xml", STATEMENT.format(acc="A1"))
    rows = statement_source.read_statements(spark, str(tmp_path / "in")).withColumn("NAME", F.lit("Ёлка № 5 «ж» é 漢"))
    statements.write_exchange(rows, OWNER, "Us", "Them", str(tmp_path / "out"), ["position"], windows=True)
    folder = tmp_path / "out" / "account_id=A1"
    body = b"".join((folder / n).read_bytes() for n in sorted(os.listdir(folder)) if n.startswith("part-"))
    text_ = body.decode("cp1251")
    assert "НазначениеПлатежа=Ёлка № 5 «ж» ? ?\n" in text_ and text_.count("СекцияДокумент=Платежное поручение") == 3


def test_corpus_scan_and_reindex(spark, tmp_path):
    write(tmp_path / "a.md", "# Первый\n\nДостаточно длинный текст для индекса.\n\nshort\n")
    write(tmp_path / "sub" / "b.md", b"# Second\n\nbroken \xff bytes but long enough text\n")
    write(tmp_path / "c.txt", "no")
    docs = corpus.read_corpus(spark, str(tmp_path))
    assert sorted(r.source for r in docs.collect()) == ["a.md", "b.md"]
    assert "�" in docs.filter("source = 'b.md'").first().text
    from atticwork.operators.nearest import letter_vector

    corpus.reindex(spark, docs, "kb_chunks", lambda texts: [[float(len(x))] for x in texts], letter_vector)
    stored = spark.table("kb_chunks")
    assert stored.count() == 4 and stored.select("id").distinct().count() == 4
    assert {r.section for r in spark.table("kb_chunks_sections").collect()} == {"Первый", "Second"}
    corpus.write_chunks(stored.drop("id").limit(1), "kb_chunks")
    assert spark.table("kb_chunks").count() == 5
    corpus.reindex(spark, docs, "kb_chunks", lambda texts: [[1.0] for _ in texts], letter_vector)
    assert spark.table("kb_chunks").count() == 4
    corpus.drop_chunks(spark, "kb_chunks")
    assert not spark.catalog.tableExists("kb_chunks")


def test_sql_text_and_file(spark, tmp_path):
    tables.register_views({"t_views": spark.range(5)})
    assert tables.run_sql(spark, "SELECT count(*) AS n FROM t_views;").first().n == 5
    (tmp_path / "q.sql").write_text("SELECT max(id) AS m\nFROM t_views\n;\n")
    assert tables.run_sql_file(spark, str(tmp_path / "q.sql")).first().m == 4
    assert tables.read_tables(spark, "/root/testdata/sf0.001", ["region"])["region"].count() == 5


def test_links_are_cleaned(spark):
    df = spark.createDataFrame([("[a](#_Ref1) [b](http://x/y) c (#_T1) {#id .k} ",)], "s string")
    assert df.select(text.markdown_clean("s").alias("c")).first().c == "a b c"


def test_timestamps_of_leads(spark):
    df = spark.createDataFrame([("79161234567", 1700000000123)], "phone string, created_at long")
    row = leads.show_leads(df).first()
    assert row.phone == "+7 (916) 123-45-67" and row.created_at == dt.datetime(2023, 11, 14, 22, 13, 20, 123000)


def test_small_files_are_written_by_many_tasks_one_per_key(spark, tmp_path):
    """So little text was one task, which made every file by itself."""
    from atticwork.sources.files import write_small_files

    rows = [(i, f"text {i}") for i in range(300)] + [(7, "again"), (None, "no key"), (-3, None)]
    folder = f"file://{tmp_path}/small"
    write_small_files(spark.createDataFrame(rows, "id long, value string"), "id", "value", folder, "txt")
    found = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("path")).collect()
    texts = {r.path.rsplit("/", 1)[1]: r.value for r in found}
    assert len(found) == len(texts) == 302
    assert texts["id=7.txt"] == "again\ntext 7\n" and texts["id=-3.txt"] == "\n" and texts["id=8.txt"] == "text 8\n"
    assert texts["id=__HIVE_DEFAULT_PARTITION__.txt"] == "no key\n"
    assert len({r.path.rsplit("/", 2)[1] for r in found}) >= 8
    write_small_files(spark.createDataFrame([], "id long, value string"), "id", "value", f"file://{tmp_path}/none", "txt")
    assert spark.read.text(f"file://{tmp_path}/none", wholetext=True, recursiveFileLookup=True).count() == 0
