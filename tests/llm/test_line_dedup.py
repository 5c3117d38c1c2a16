import hashlib
import time

from pyspark.sql import functions as F

from atticwork.llm import line_dedup

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def brute(rows, least=20, docs=3):
    key = lambda x: x.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(str.maketrans(UPPER, LOWER))
    held = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                held.setdefault(key(line), set()).add(doc)
    top = lambda ids: max(ids, key=lambda i: (i is not None, i or 0))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= docs and top(held[key(x)]) != doc)]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


LONG = "This line stands in many documents"
ROWS = [
    (1, f"{LONG}\nown text\n  {LONG.upper()}\t\nend"), (2, f"{LONG}\r\n\nshort"), (3, f"x\n{LONG}"), (4, None), (5, ""), (6, "\n\n"),
    (7, "ünïcödé line with twenty+ chars\n" * 3), (8, "ünïcödé line with twenty+ chars"), (9, "ÜNÏcödé line with twenty+ chars"),
    (10, "y" * 100_000 + "\n" + LONG), (11, f"{LONG}\n{LONG}"), (11, f"again {LONG}\n{LONG}"), (None, LONG),
]


def test_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = [tuple(r) for r in line_dedup.query(docs).collect()]
    assert sorted(got, key=repr) == sorted(brute(ROWS), key=repr)


def test_other_columns_and_empty(spark):
    docs = spark.createDataFrame([(1, LONG, 5, "d"), (2, LONG, 6, None), (3, LONG, None, "e")], "doc_id long, text string, h1 int, drop string")
    out = line_dedup.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "h1", "drop", "n_lines", "n_dropped"]
    assert {(r.doc_id, r.text, r.h1, r["drop"]) for r in out.collect()} == {(1, "", 5, "d"), (2, "", 6, None), (3, LONG, None, "e")}
    assert line_dedup.dedup_lines(docs.where(F.lit(False))).collect() == []


def test_texts_of_many_lines_take_linear_time(spark):
    lines = 200_000
    made = spark.range(3).select(
        F.col("id").alias("doc_id"),
        F.array_join(F.transform(F.sequence(F.lit(1), F.lit(lines)), lambda i: F.concat(
            F.when(i % 2 == 0, F.lit("a line that all of them have ")).otherwise(F.concat(F.lit("one that nobody else has "), F.col("id").cast("string"))), i.cast("string"),
        )), "\n").alias("text"),
    )
    start = time.time()
    got = sorted((r.doc_id, r.n_lines, r.n_dropped) for r in line_dedup.query(made).collect())
    assert got == [(0, lines, lines // 2), (1, lines, lines // 2), (2, lines, 0)]
    assert time.time() - start < 60


def test_places_far_apart(spark):
    shared = [f"line number {i} that three documents hold" for i in range(4)]
    gaps = "\n".join(x for i, line in enumerate(shared) for x in [line, *[f"own {i} {k}" for k in range(70 * i)]])
    rows = [(1, gaps), (1, "\n".join(shared[::-1])), (2, "x\n" * 64 + shared[3]), (2, "\n".join(shared)), (3, "\n".join(shared) + "\nend")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in line_dedup.query(docs).collect()), key=repr) == sorted(brute(rows), key=repr)
