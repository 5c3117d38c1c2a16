import random
import re

import pytest
from pyspark.sql import functions as F

from atticwork.llm import ngram_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def brute(rows, size, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(UPPER, LOWER)))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    name = list(range(len(rows)))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                name[max(x, y)] = min(x, y)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return [(doc, len(sets[i]), least.get(root(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)]


def made(seed=5):
    turn = random.Random(seed)
    word = lambda: turn.choice(["the", "of"]) if turn.random() < 0.3 else f"w{turn.randrange(3000)}"
    passage = [word() for _ in range(30)]
    texts = [[word() for _ in range(turn.randint(1, 150))] for _ in range(60)]
    for i in range(0, 60, 3):
        texts[i] = passage + texts[i]
    hot = [word() for _ in range(120)]
    for i in range(140):  # a chain of near copies, each a word or two from one before
        source = hot if i < 60 else texts[turn.randrange(len(texts))]
        copy = list(source)
        for _ in range(turn.randint(0, 3)):
            copy[turn.randrange(len(copy))] = f"n{turn.randrange(10**6)}"
        texts.append(copy)
    texts += [list(hot)] * 40
    turn.shuffle(texts)
    rows = [(i * 3 + 1, " ".join(t) if i % 4 else "\t" + " \n".join(t).upper()) for i, t in enumerate(texts)]
    return rows + [(9000, None), (9001, ""), (9002, " \n"), (9003, "one two"), (9004, "ONE two"), (9005, "word " * 50_000), (10, rows[3][1]), (None, "alone here")]


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (2, 60)])
def test_brute_force(spark, size, percent):
    rows = made(size)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngram_join.link_components(docs, size, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found), key=repr) == sorted(brute(rows, size, percent), key=repr)


def test_full_round_alone(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEADER_ROUNDS", 0)
    rows = made(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngram_join.query(docs).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(brute(rows, 4, 85), key=repr)


def test_one_per_group(spark):
    rows = made(7)
    docs = spark.createDataFrame([(*r, "k", i) for i, r in enumerate(rows)], "doc_id long, text string, sid string, c int")
    kept = ngram_join.one_per_group(docs)
    assert kept.columns == docs.columns
    want = sorted(i for i, (doc, _, c) in enumerate(brute(rows, 5, 80)) if doc is None or doc == c or any(r[0] == doc and r[2] == doc for r in brute(rows, 5, 80)))
    assert sorted(r.c for r in kept.collect()) == want


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.query(docs).collect() == []
    assert ngram_join.one_per_group(docs).collect() == []
    assert ngram_join.query(spark.createDataFrame([(1, None)], "doc_id long, text string")).where(F.lit(True)).collect()[0].component_id == 1
