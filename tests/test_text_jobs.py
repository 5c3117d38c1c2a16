import random
import time

import pytest
from pyspark.sql import functions as F

from atticwork import sql_functions
from atticwork.functions import text
from atticwork.operators import books, chunking, markdown, transcripts
from atticwork.plans import CATALOG
from atticwork.sources import books as book_source

MD = """# Top

Intro with [a link](#_Ref1) and {#id .c} more.

## Nets

| Name | IP |
|------|----|
| a | 10.0.0.1 | extra |
| b |
| c\\|d | x |

+-----+-------+
| H1  | H2    |
+-----+-------+
| a   | one   |
|     | two   |
+-----+-------+
| H1  | H2    |
+-----+-------+

### Deep
deep text
second line

## After

| only | header |
|------|--------|

- one
  more
- two

# Второй #
текст
```
# not a heading

| x | y |
|---|---|
```
after
"""


@pytest.fixture(scope="module")
def chunked(spark):
    corpus = spark.createDataFrame([(1, "a.md", MD), (2, "a.md", "plain only")], "doc long, source string, text string")
    return chunking.chunk_markdown(corpus).cache()


def pick(chunked, section, kind, doc=1):
    own = chunked.filter((F.col("section") == section) & (F.col("chunk_type") == kind) & (F.col("doc") == doc))
    return [(r.chunk_index, r.content) for r in own.orderBy("chunk_index").collect()]


def test_breadcrumbs_reset(chunked):
    assert {r.section for r in chunked.filter("doc = 1").select("section").distinct().collect()} == {
        "Top", "Top > Nets", "Top > Nets > Deep", "Top > After", "Второй",
    }
    assert pick(chunked, "", "", 2) == [(1, "plain only")]


def test_prose_is_cleaned(chunked):
    assert pick(chunked, "Top", "paragraph_full") == [(1, "Intro with a link and  more.")]
    assert pick(chunked, "Top > Nets > Deep", "") == [(1, "deep text\nsecond line")]


def test_pipe_and_grid_tables(chunked):
    assert pick(chunked, "Top > Nets", "table_row") == [
        (0, '["a","10.0.0.1"]'), (1, '["b",""]'), (2, '["c|d","x"]'), (3, '["a","one two"]'),
    ]
    full = pick(chunked, "Top > Nets", "table_full")
    assert [i for i, _ in full] == [1, 2] and full[1][1].startswith("+-----+")
    heads = {r.table_headers for r in chunked.filter("chunk_type = 'table_row'").collect()}
    assert heads == {'["Name","IP"]', '["H1","H2"]'}


def test_table_without_rows_stays_raw(chunked):
    assert pick(chunked, "Top > After", "table_raw") == [(1, "| only | header |\n|------|--------|")]


def test_list_items_are_blocks_too(chunked):
    assert pick(chunked, "Top > After", "") == [(1, "- one\n  more\n- two"), (2, "- one\n  more"), (3, "- two")]


def test_code_is_one_block(chunked):
    assert [c for _, c in pick(chunked, "Второй", "")] == ["текст", "```\n# not a heading\n\n| x | y |\n|---|---|\n```", "after"]


def test_grep_context(spark):
    corpus = spark.createDataFrame([(1, "a.md", "one\ntwo СЛОВО слово\nthree\nfour")], "doc long, source string, text string")
    got = chunking.grep_context(corpus, "слово", 1).collect()
    assert [(r.line_no, r.match) for r in got] == [(2, "СЛОВО"), (2, "слово")]
    assert got[0].context == "    one\n>>> two СЛОВО слово\n    three"


def found(source):
    return [(b["line_start"], b["line_end"], b["kind"], " > ".join(b["headings"])) for b in markdown.blocks_of(source)]


def test_underlined_headings():
    assert found("Top\n===\na\n\nLong\ntitle\n  ---\nb\n\n- x\n---\n\n# One #\n## Two#") == [
        (3, 3, "prose", "Top"), (8, 8, "prose", "Top > Long title"), (10, 10, "prose", "Top > Long title"), (11, 11, "prose", "Top > Long title"),
    ]
    assert found("# A ##\n### C\nc\n## B\nb")[0][3] == "A > C" and found("# A ##\n### C\nc\n## B\nb")[1][3] == "A > B"


def test_fences_by_sign_and_length():
    assert found("````\n```\n# no\n```\n````\n# yes\na") == [(1, 5, "prose", ""), (7, 7, "prose", "yes")]
    assert found("~~~ x`y\n```\n# no\n~~~~\n# yes\na") == [(1, 4, "prose", ""), (6, 6, "prose", "yes")]
    assert found("``` a`b\n# yes\n\n    ```\n\n```\nopen") == [(1, 1, "prose", ""), (4, 4, "prose", "yes"), (6, 7, "prose", "yes")]


def test_tables_end_at_other_blocks():
    table = "| a | b |\n|---|---|\n| 1 | 2 |\n"
    for other in ("```\ncode\n```", "# h\nx", "> q", "- i", "---", "<div>"):
        assert found(table + other)[0] == (1, 3, "pipe", "")
    assert found("text\n" + table + "| 3 |\n\nend") == [(1, 1, "prose", ""), (2, 5, "pipe", ""), (7, 7, "prose", "")]
    assert found("| a | b |\n|---|\n") == [(1, 2, "prose", "")]


def test_lists_and_what_they_hold():
    assert found("- a\n\n- b\n\n  more\n\nend") == [
        (1, 5, "prose", ""), (1, 1, "prose", ""), (3, 5, "prose", ""), (3, 3, "prose", ""), (5, 5, "prose", ""), (7, 7, "prose", ""),
    ]
    assert found("1. a\n   - x\n   - y\nlazy\n2. b\n* c") == [
        (1, 5, "prose", ""), (1, 4, "prose", ""), (1, 1, "prose", ""), (2, 4, "prose", ""), (2, 2, "prose", ""), (3, 4, "prose", ""),
        (5, 5, "prose", ""), (6, 6, "prose", ""),
    ]
    assert found("- ```\n  # no\n\n  ```\n- # in\n\nx") == [
        (1, 5, "prose", ""), (1, 4, "prose", ""), (5, 5, "prose", ""), (7, 7, "prose", "in"),
    ]
    assert found("a\n2. b\n\n2. c") == [(1, 2, "prose", ""), (4, 4, "prose", "")]


def test_quotes_html_and_indents():
    assert found("> # in\n> | a | b |\n> |--|--|\n> | 1 | 2 |\nnext") == [(1, 5, "prose", ""), (2, 5, "pipe", "in")]
    assert markdown.blocks_of("> | a | b |\n> |--|--|\n> | 1 | 2 |")[1]["lines"] == ["| a | b |", "|--|--|", "| 1 | 2 |"]
    assert found("<!-- # no\n\n# no -->\n    code\n\n    # no\ntext\n    text") == [(1, 3, "prose", ""), (4, 6, "prose", ""), (7, 8, "prose", "")]
    assert found("<div>\n# no\n\n# yes\nx") == [(1, 2, "prose", ""), (5, 5, "prose", "yes")]
    assert found(None) == found("") == found(" \n\t\n") == found("# only") == []


@pytest.mark.parametrize("unit", ["> ", "- ", "#", "`", "| ", "# " + " " * 50, "a\n", "> a\nb\n", "- a\n\n", "```\n", "<a "])
def test_long_texts_take_little_time(unit):
    start = time.time()
    markdown.blocks_of(unit * 40_000)
    markdown.blocks_of("x\n" + unit * 40_000 + "\ny")
    assert time.time() - start < 20


def test_chunks_are_dealt_once(spark, tmp_path):
    path = str(tmp_path / "corpus")
    spark.createDataFrame([(i, "a.md", MD) for i in range(50)], "doc long, source string, text string").write.parquet(path)
    corpus = spark.read.parquet(path)
    plan = chunking.chunk_markdown(corpus)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Exchange" not in chunking.grep_context(corpus, "deep")._jdf.queryExecution().executedPlan().toString()


def test_cut_by_size_small_cases():
    assert chunking.cut_by_size("short", 10, 3) == ["short"]
    assert chunking.cut_by_size("   ", 10, 3) == []
    assert chunking.cut_by_size("aaaa\nbbbb\ncccc", 9, 2) == ["aaaa\nbbbb", "bb\ncccc"]
    assert chunking.cut_by_size("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]


def test_cut_by_size_keeps_every_word_and_the_bound():
    rnd = random.Random(5)
    for _ in range(50):
        words = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 9))) for _ in range(60)]
        source = "".join(w + rnd.choice([" ", " ", "\n", "\n\n"]) for w in words)
        pieces = chunking.cut_by_size(source, 40, 8)
        assert all(len(p) <= 40 for p in pieces)
        joined = " ".join(pieces)
        assert all(w in joined for w in words)


def test_sentence_split(spark):
    df = spark.createDataFrame([("  One. Two!  Three?\nfour 1.5 end. ",), ("",)], "s string")
    got = [r.x for r in df.select(text.sentences("s").alias("x")).collect()]
    assert got == [["One.", "Two!", "Three?", "four 1.5 end."], []]


def test_packing_keeps_every_sentence_and_offsets():
    sentences = [f"Sentence number {i} {'x' * (i * 7 % 60)}." for i in range(60)]
    chunks = books.pack_text(sentences, 50, 200, 40)
    body = "\n".join(c[0] for c in chunks)
    assert all(s in body for s in sentences)
    assert all(len(c[0]) == c[2] - c[1] for c in chunks[:-1])
    assert chunks[0][1] == 0 and all(a[2] > b[1] for a, b in zip(chunks, chunks[1:]))
    tiny = books.pack_text(["a" * 90 + ".", "b" * 90 + ".", "c."], 50, 100, 0)
    assert [len(t) for t, _, _ in tiny] == [91, 94]


def test_pack_sentences_column(spark):
    df = spark.createDataFrame([(1, "Aa bb. " * 100), (2, ""), (3, None)], "id int, t string")
    got = books.pack_sentences(df, "t", 70, 150, 20).collect()
    assert {r.id for r in got} == {1} and [r.chunk_no for r in got] == list(range(len(got)))


def test_long_sections_are_cut_at_blank_lines(spark):
    rnd = random.Random(2)
    data = []
    for i in range(40):
        content = "\n\n".join("p" * rnd.choice([0, 3, 20, 90]) for _ in range(rnd.randrange(1, 25)))
        data.append((i, f"T{i}", content))
    df = spark.createDataFrame(data, "id int, title string, content string")
    got = {}
    for r in sorted(books.split_long_section(df, "title", "content", 100).collect(), key=lambda r: (r.id, r.part_no)):
        got.setdefault(r.id, []).append((r.part_title, r.part_content))
    for i, title, content in data:
        titles, parts = zip(*got[i])
        assert "\n\n".join(parts) == content
        if len(content) <= 100:
            assert titles == (title,)
            continue
        assert all(name.startswith(f"{title} - ") and name.endswith(f" {n}") for n, name in enumerate(titles, 1))
        target = len(content) // -(-len(content) // 100)
        # A part goes over the target by its first paragraph only, and no paragraph that still fits waits for the next part.
        for part, following in zip(parts, parts[1:]):
            assert len(part) <= target or "\n\n" not in part
            assert len(part) + 2 + len(following.split("\n\n")[0]) + 2 > target


def test_an_empty_section_is_one_part(spark):
    df = spark.createDataFrame([(1, "E", ""), (2, "T", "aa\n\nbb"), (3, "N", None)], "id int, title string, content string")
    got = books.split_long_section(df, "title", "content", 5).select("id", "part_no", "part_title", "part_content").filter("id < 3").collect()
    assert sorted(map(tuple, got)) == [(1, 0, "E", ""), (2, 0, "T - часть 1", "aa"), (2, 1, "T - часть 2", "bb")]


def test_long_sections_of_many_blocks_of_paragraphs_are_cut_as_in_one_fold(spark, monkeypatch):
    monkeypatch.setattr(books, "FOLDED", 7)
    rnd = random.Random(5)
    contents = ["\n\n".join("p" * rnd.choice([0, 1, 9, 40]) for _ in range(n)) for n in (1, 6, 7, 8, 14, 15, 300)]
    df = spark.createDataFrame(list(enumerate(contents)), "id int, content string").withColumn("title", F.lit("T"))
    got: dict[int, list] = {}
    for r in sorted(books.split_long_section(df, "title", "content", 50).collect(), key=lambda r: (r.id, r.part_no)):
        got.setdefault(r.id, []).append(r.part_content)
    for i, content in enumerate(contents):
        parts, held = [], 0
        target = len(content) // max(1, -(-len(content) // 50))
        for p in content.split("\n\n") if len(content) > 50 else [content]:
            if parts and held + len(p) + 2 > target:
                parts.append([p])
                held = len(p)
            else:
                parts = parts or [[]]
                parts[-1].append(p)
                held += len(p) + 2
        assert got[i] == ["\n\n".join(p) for p in parts]


EMPTY_AND_LONG = [(1, ""), (2, "a\nb"), (3, "\n".join(["w" * 99] * 30))]


def test_characters_of_long_sections_with_an_empty_text(spark, tmp_path):
    spark.createDataFrame(EMPTY_AND_LONG, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    chars = {r.doc_id: r.chars for r in CATALOG["long_section_chars"](spark, str(tmp_path)).collect()}
    assert chars == {i: len(text.replace("\n", "")) for i, text in EMPTY_AND_LONG}


def test_parts_of_long_sections_with_an_empty_text(spark, tmp_path):
    spark.createDataFrame(EMPTY_AND_LONG, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    parts: dict[int, list] = {}
    for r in sorted(CATALOG["long_section_parts"](spark, str(tmp_path)).collect(), key=lambda r: (r.doc_id, r.part_no)):
        parts.setdefault(r.doc_id, []).append(r.part_content)
    assert {i: "\n\n".join(p) for i, p in parts.items()} == {i: text.replace("\n", "\n\n") for i, text in EMPTY_AND_LONG}
    assert parts[1] == [""] and len(parts[3]) > 1


def test_nested_book_from_xml(spark, tmp_path):
    xml = """<FictionBook><body><title><p>Book</p></title>
      <section><title><p>Part</p></title>
        <section><title><p>1</p></title><p>one </p><p>two</p></section>
        <section><title><p>2</p></title><p>three</p></section>
        <section><title><p>1</p></title><p>again</p></section>
      </section>
      <section><title><p>Empty</p></title></section>
      <section><p>untitled</p></section>
    </body></FictionBook>"""
    (tmp_path / "b.fb2").write_text(xml, encoding="utf-8")
    leaf = "struct<title: struct<p: string>, p: array<string>>"
    schema = f"section array<struct<title: struct<p: string>, p: array<string>, section: array<{leaf}>>>"
    tree = spark.read.format("xml").option("rowTag", "body").schema(schema).load(str(tmp_path / "b.fb2"))
    flat = tree.select(
        F.lit("b").alias("book"),
        F.transform(
            "section",
            lambda s: F.struct(
                s["title"]["p"].alias("title"), s["p"].alias("p"),
                F.transform(s["section"], lambda n: F.struct(n["title"]["p"].alias("title"), n["p"].alias("p"))).alias("section"),
            ),
        ).alias("sections"),
    )
    leaves = books.flatten_sections(flat)
    assert [(r.title, r.content) for r in leaves.orderBy("path").collect()] == [
        ("Part - 1", "one\ntwo"), ("Part - 2", "three"), ("Part - 1", "again"), ("", "untitled"),
    ]
    existing = spark.createDataFrame([("b", 4, "Part - 2")], "book string, idx long, title string")
    got = books.number_sections(leaves, existing).orderBy("idx").collect()
    assert [(r.idx, r.title, r.file_name) for r in got] == [(5, "Part - 1", "0005_part_1"), (6, "", "0006")]


def test_books_of_any_depth_many_in_a_file(spark, tmp_path):
    def book(name, sections):
        return f"<FictionBook><description><title-info><book-title>{name}</book-title></title-info></description><body><title><p>x</p></title>{sections}</body></FictionBook>"

    deep = "<section><title><p>L{n}</p></title>{inner}</section>"
    inner = "<p>deep <emphasis>text</emphasis></p>"
    for n in range(5, 0, -1):
        inner = deep.format(n=n, inner=inner)
    beyond = "<p>far</p>"
    for n in range(4, 0, -1):
        beyond = deep.format(n=n, inner=beyond)
    many = "".join(book(f"B{i}", f"<section><title><p>S</p><p>{i}</p></title><p>text {i}</p></section>") for i in range(300))
    (tmp_path / "many.fb2").write_text(f"<books>{book('Deep', inner)}{many}{book('Empty', '')}</books>", encoding="utf-8")
    tree = book_source.scan_books(spark.newSession(), str(tmp_path / "many.fb2"))
    assert tree.count() == 302
    got = {r.book: (r.title, r.content) for r in books.flatten_sections(tree).collect()}
    assert len(got) == 301 and got["Deep"] == ("L1 - L2 - L3 - L4 - L5", "deep text") and got["B7"] == ("S 7", "text 7")
    old = '<?xml version="1.0" encoding="windows-1251"?>' + book("Книга", "<section><p>Ёж — №1</p></section>")
    (tmp_path / "old.fb2").write_bytes(old.encode("cp1251"))
    assert [(r.book, r.content) for r in books.flatten_sections(book_source.scan_books(spark, str(tmp_path / "old.fb2"), windows=True)).collect()] == [("Книга", "Ёж — №1")]
    (tmp_path / "far.fb2").write_text(book("Far", beyond), encoding="utf-8")
    far = books.flatten_sections(book_source.scan_books(spark, str(tmp_path / "far.fb2"), depth=2)).collect()
    assert [(r.title, "far" in r.content) for r in far] == [("L1 - L2", True)]


def test_a_file_of_books_is_read_in_parallel(spark, tmp_path):
    one = "<FictionBook><body>\n<section><p>{}</p></section>\n</body></FictionBook>\n".format("word " * 400)
    (tmp_path / "big.fb2").write_text("<books>" + one * 600 + "</books>", encoding="utf-8")
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", str(200_000))
    tree = book_source.scan_books(own, str(tmp_path / "big.fb2"))
    assert tree.count() == 600 and tree.rdd.getNumPartitions() > 3


def test_titles(spark):
    df = spark.createDataFrame([("ЧАСТЬ ПЕРВАЯ - 1",), ("x" * 49 + " yy",), ("???",)], "t string")
    assert [r.x for r in df.select(text.file_title("t").alias("x")).collect()] == ["часть_первая_1", "x" * 49 + "_yy", ""]
    assert [r.x for r in df.select(text.trailing_number("t").alias("x")).collect()] == [1, None, None]


def test_summary_queue(spark):
    sections = spark.createDataFrame(
        [(1, "=== T ===\n\n" + "a" * 1200), (2, "b" * 999), (3, "c" * 2000), (4, "d" * 1000)], "idx int, content string"
    )
    done = spark.createDataFrame([(3,)], "idx int")
    got = {r.idx: r.prompt_text for r in books.summary_queue(sections, done, ["idx"], books.MIN_SINGLE).collect()}
    assert set(got) == {1, 4} and got[1] == "a" * 1200


def test_run_report_divides_by_all_runs(spark):
    runs = spark.createDataFrame([("a", 10.0, True, None), ("b", 20.0, False, "x")], "model string, duration double, success boolean, error string")
    assert tuple(books.run_summary(runs).first()) == (2, 1, 1, 30.0, 15.0)
    assert [tuple(r) for r in books.failed_runs(runs).collect()] == [("b", "x")]


def bounds_plain(total, length, overlap):
    out, start = [], 0.0
    while start < total:
        end = min(start + length, total)
        if end - start < 5:
            break
        out.append((start, end))
        start += length - overlap
    return out


@pytest.mark.parametrize("total", [0.0, 4.0, 5.0, 29.0, 30.0, 54.0, 55.0, 79.9, 80.0, 300.0])
def test_window_bounds(spark, total):
    df = spark.createDataFrame([(total,)], "total double")
    got = [(r.start_sec, r.end_sec) for r in transcripts.window_bounds(df, "total", 30, 5).orderBy("window_no").collect()]
    assert got == bounds_plain(total, 30, 5)


def test_exactly_one_copy_survives(spark):
    # Stretches of two seconds put many look-aheads across a border.
    data = []
    for i in range(60):
        data.append(("f", i, float(i), float(i) + 1, f"w{i} w{i}a w{i}b" if i % 5 else "same words here"))
        if i % 7 == 0:
            data.append(("f", 1000 + i, i + 1.5, i + 2.5, data[-1][4].upper()))
    df = spark.createDataFrame(data, "file string, id int, start double, end double, text string")
    kept = {r.id for r in transcripts.dedupe_overlap(df, 1.0).collect()}
    rows = sorted(data, key=lambda r: (r[2], r[1]))
    expected = set()
    for k, r in enumerate(rows):
        ahead = [n for n in rows[k + 1 :] if n[2] <= r[2] + 2.0]
        if not any(set(n[4].lower().split()) == set(r[4].lower().split()) for n in ahead):
            expected.add(r[1])
    assert kept == expected and 7 not in kept and 1007 in kept


def test_pause_equal_to_the_threshold_splits(spark):
    data = [("f", 1, 10.0, 11.0, "a"), ("f", 2, 12.9, 14.0, "b"), ("f", 3, 16.0, 17.0, "c")]
    df = spark.createDataFrame(data, "file string, id int, start double, end double, text string")
    got = [(r.block, r.start_sec, r.text) for r in transcripts.pause_blocks(df, 2.0).orderBy("block").collect()]
    assert got == [(1, 10.0, "a\nb"), (2, 16.0, "c")]


def test_speaker_turns(spark):
    data = [("f", 1, 500.0, "A", "one two"), ("f", 2, 501.0, "A", "three"), ("f", 3, 502.0, "B", "x"), ("f", 4, 502.4 + 2, "B", "y")]
    df = spark.createDataFrame(data, "file string, id int, start_sec double, speaker string, text string")
    got = [(r.speaker, r.start_sec, r.text) for r in transcripts.speaker_turns(df, 2.0).orderBy("turn").collect()]
    assert got == [("A", 500.0, "one two three"), ("B", 502.0, "x"), ("B", 504.4, "y")]


def test_every_sentence_is_in_a_block(spark, split_everything):
    rnd = random.Random(4)
    data, at = [], 0.0
    for i in range(400):
        at += rnd.choice([0.5, 1, 9])
        data.append(("f", i, at, at + 0.4, f"s{i}"))
    df = spark.createDataFrame(data, "file string, id int, start double, end double, text string")
    blocks = transcripts.pause_blocks(df, 3.0).orderBy("block", "part").collect()
    assert "\n".join(b.text for b in blocks).split("\n") == [f"s{i}" for i in range(400)]


def test_speaker_names_wrap_around(spark):
    df = spark.createDataFrame([("f", f"S{i}") for i in range(5)] * 2, "file string, speaker string")
    got = {r.speaker: r.display_name for r in transcripts.speaker_names(df, ["Ann", "Bob"]).collect()}
    assert len(set(got.values())) == 5 and {got["S0"], got["S1"]} == {"Ann", "Bob"}
    assert got["S2"] == got["S0"] + "-2" and got["S4"] == got["S0"] + "-3"


@pytest.mark.parametrize("seconds, shown", [(0, "[00:00:00]"), (3725.9, "[01:02:05]"), (86400, "[1 day, 0:00:00]"), (180000, "[2 days, 2:00:00]")])
def test_clock(spark, seconds, shown):
    assert spark.range(1).select(text.clock(F.lit(float(seconds))).alias("c")).first().c == shown


def test_chunks_by_sql_function(spark):
    rnd = random.Random(3)
    pieces = [MD, "> q\n> | a | b |\n> |--|--|\n> | 1 \\| 2 | \"x\" |", "text " * 700, "+--+\n| a\n", "- a\n\n  b\n- c\n", "T\n==\n", "\n\n", "* **x** [l](u)\n"]
    texts = ["".join(rnd.choices(pieces, k=4)) for _ in range(30)] + [None, ""]
    corpus = spark.createDataFrame([(i, "s", x) for i, x in enumerate(texts)], "doc long, source string, text string")
    corpus.createOrReplaceTempView("chunk_corpus")
    sql_functions.register(spark)
    by_sql = spark.sql("SELECT * FROM chunk_markdown(TABLE(chunk_corpus), 400, 40)")
    plain = chunking.chunk_markdown(corpus, 400, 40).withColumn("doc", F.col("doc").cast("string")).select(*by_sql.columns)
    assert sorted(map(tuple, by_sql.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    assert by_sql.count() > 200
