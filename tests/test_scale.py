"""Steps that grew faster than their input, or were one task's work."""

import pyarrow as pa
from pyspark.sql import functions as F

from atticwork.operators import books, chunking, markdown, statements
from atticwork.sources.corpus import read_corpus


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_code_page_is_written_without_a_look_at_each_character_by_the_jvm(spark):
    texts = ["Плательщик=ООО «Ёж» № 5", "", None, "plain", "a\U0001f600b\x98c", "日本", "€ é ÿ я"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "id int, s string").select("id", statements.windows_1251(F.col("s")).alias("w"))
    found = dict(df.select("id", F.col("w").cast("binary")).collect())
    assert [None if found[i] is None else bytes(found[i]) for i in range(len(texts))] == [None if s is None else s.encode("cp1251", "replace") for s in texts]
    back = dict(df.select("id", statements.from_windows_1251(F.col("w"))).collect())
    assert back[0] == texts[0] and back[2] is None and back[4] == "a?b?c"
    assert "translate(" not in plan(df)


def test_texts_of_an_arrow_batch_are_worked_on_in_slices(spark):
    batch = pa.array(["a" * 400, None, "", "b" * 700, "c" * 3000, "d"])
    parts = list(markdown.slices(batch, 1000))
    assert pa.concat_arrays(parts).equals(batch) and [len(p) for p in parts] == [3, 1, 2]
    assert [len(p) for p in markdown.slices(pa.array([], pa.string()))] == [0]
    rows = [(i, "s", f"# T{i}\n\n" + f"word{i} " * 40_000) for i in range(12)]
    out = chunking.chunk_markdown(spark.createDataFrame(rows, "doc int, source string, text string").coalesce(1))
    assert out.filter("chunk_type = 'paragraph_full'").count() == 12
    assert out.filter(~F.col("content").contains(F.concat(F.lit("word"), F.col("doc").cast("string"), F.lit(" ")))).count() == 0


def test_a_book_is_read_and_cut_up_once(spark):
    schema = "book int, sections array<struct<title: string, p: array<string>, section: array<struct<title: string, p: array<string>>>>>"
    rows = [
        (1, [("A", ["own "], [(" x ", ["1", " "]), (None, ["2"]), ("x", ["3"])]), ("", ["plain"], None), ("A", ["last"], []), None]),
        (1, [("B", ["other"], [])]), (2, None), (3, []),
    ]
    tree = spark.createDataFrame(rows, schema)
    leaves = books.flatten_sections(tree)
    assert sorted(map(tuple, leaves.collect())) == [
        (1, "00000000.", "B", "other"), (1, "00000000.00000000.", "A - x", "1"), (1, "00000000.00000001.", "A", "2"),
        (1, "00000000.00000002.", "A - x", "3"), (1, "00000001.", "", "plain"), (1, "00000002.", "A", "last"),
    ]
    assert plan(leaves).count("Scan") == 1
    numbered = books.number_sections(leaves)
    assert plan(numbered).count("Exchange") == 1
    assert sorted((r.idx, r.title, r.content) for r in numbered.collect()) == [
        (0, "B", "other"), (1, "A - x", "1"), (2, "A", "2"), (3, "", "plain")
    ]


def test_small_documents_are_read_by_few_tasks(spark, tmp_path):
    for i in range(2000):
        (tmp_path / f"{i}.md").write_text(f"# {i}\n")
    read = read_corpus(spark, str(tmp_path))
    assert read.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert read.select("source", "text").distinct().count() == 2000
