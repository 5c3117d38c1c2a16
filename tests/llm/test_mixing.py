import math
import random
import re

import pytest
from pyspark.sql import functions as F

from atticwork.llm import mixing


def water_fill(sizes, weights=(1, 2, 3), cap=3):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        if not open_:
            break
        level = (total - sum(cap * sizes[s] for s in full)) / sum(weight[s] for s in open_)
        more = {s for s in open_ if level * weight[s] >= cap * sizes[s]}
        if not more:
            break
        full |= more
    return {s: float(cap * sizes[s]) if s in full else level * weight[s] for s in names}


@pytest.fixture(scope="module")
def docs(spark):
    turn = random.Random(2)
    rows = []
    for i in range(1500):
        source = turn.choice(["a", "b", "b", "b", "b", "c", "Z", "é", None])
        rows.append((i, " ".join(["w"] * min(4000, int(turn.paretovariate(1.1) * 8))), source))
    rows += [(5000, None, "a"), (5001, "", "b"), (5002, " \t\n", "only empty"), (5003, "one", "tiny"), (7, rows[7][1], rows[7][2])]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_and_words(spark, docs):
    rows = mixing.query(docs).join(docs.select("doc_id", "source", "text").dropDuplicates(), "doc_id").collect()
    sizes, taken, largest = {}, {}, {}
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
    want = water_fill(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1, s


def test_reruns_agree_and_columns_pass(docs):
    one = mixing.mix(docs.withColumn("size", F.lit("old")).withColumn("h", F.lit(1)))
    assert one.columns == ["doc_id", "text", "source", "h", "size", "source_size", "target", "copies"]
    a = sorted(map(tuple, one.select("doc_id", "copies").collect()))
    b = sorted(map(tuple, mixing.mix(docs.repartition(5)).select("doc_id", "copies").collect()))
    assert a == b


def test_empty(docs):
    assert mixing.mix(docs.where(F.lit(False))).collect() == []


def plain_copies(rows, targets):
    """Whole copies per row (id, size, source, h) by sorting each source's documents by Pareto ratio in Python."""
    out = {}
    for source, target in targets.items():
        own = [r for r in rows if r[2] == source]
        expected = lambda level: {r[0]: min(3.0, level * mixing.SIZE_GAIN ** (r[1].bit_length() - 1)) if r[1] else 0.0 for r in own}
        low, high = 0.0, 3.0
        for _ in range(60):
            middle = (low + high) / 2
            e = expected(middle)
            low, high = (middle, high) if sum(e[r[0]] * r[1] for r in own) < target else (low, middle)
        e = expected(high)
        certain = {r[0]: math.floor(e[r[0]] + 1e-9) for r in own}
        ranked = []
        for i, size, _, h in own:
            out[i] = certain[i]
            p = e[i] - certain[i]
            if p > 1e-9:
                u = (((h & (2**64 - 1)) >> 11) + 0.5) / 2**53
                odds = (u / (1 - u)) / (p / (1 - p))
                ranked.append((odds / (1 + odds), h, i, size))
        ranked.sort()
        short = target - sum(certain[r[0]] * r[1] for r in own)
        if short <= 0:
            continue
        rest = list(ranked)
        while rest and rest[0][3] <= short:
            short -= rest[0][3]
            out[rest.pop(0)[2]] += 1
        spare = [(abs(size - short), order, h, i) for order, h, i, size in rest if abs(size - short) < short]
        if spare:
            out[min(spare)[3]] += 1
    return out


def test_copies_are_those_of_a_plain_pareto_order(docs):
    once = docs.dropDuplicates(["doc_id"])
    found = {r.doc_id: (r.copies, r["size"], r.source, r.h, r.target) for r in mixing.mix(once.withColumn("h", F.xxhash64(F.lit(mixing.SEED), "doc_id", "text"))).collect()}
    want = plain_copies([(i, v[1], v[2], v[3]) for i, v in found.items()], {v[2]: v[4] for v in found.values()})
    assert {i: v[0] for i, v in found.items()} == want
    assert len(set(want.values())) >= 3


def test_very_long_texts_and_all_own_names_clash(spark):
    rows = [(1, "w " * 400_000, "a"), (2, "w " * 10, "a"), (3, "w " * 50, "b"), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("size", "source_size", "target", "copies", "kind", "level", "order", "bucket", "certain", "rest", "cut", "last", "extra"):
        docs = docs.withColumn(name, F.lit("old"))
    out = mixing.mix(docs)
    assert out.columns == ["doc_id", "text", "source", "kind", "level", "order", "bucket", "certain", "rest", "cut", "last", "extra", "size", "source_size", "target", "copies"]
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i]["size"] for i in (1, 2, 3, 4)] == [400_000, 10, 50, 0] and got[4].copies == 0
    assert all(r.kind == r.extra == "old" and 0 <= r.copies <= 3 for r in got.values())
