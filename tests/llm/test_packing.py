import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from atticwork.llm import packing

TEXTS = [
    (1, "Hello world, this is a text."), (2, None), (3, ""), (4, "  \n\t x"), (5, "word " * 3000), (6, "a<|endoftext|>b <|endoftext|>"),
    (7, "Éric naïve — 東京 🙂 ñandú"), (8, "x" * 5000), (9, "1234567890" * 40), (10, "it's we'll I'd"), (1, "Hello world, this is a text."), (None, "no id"),
    (11, "y " * 1023), (12, "y " * 1024),
]


def test_ids_equal_the_tokenizers_library(spark):
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.token_pieces(spark.createDataFrame(TEXTS, "doc_id long, text string")).collect()
    want = []
    for doc, text in TEXTS:
        ids = model.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids), 1024)] if len(ids) > 1024 else [0]
        for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)], strict=True)):
            raw = np.array(ids[a:b], dtype="<u4").tobytes()
            want.append((doc, i, a, b - a, zlib.crc32(raw), raw))
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_query_places(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    rows = packing.query(docs).collect()
    assert len(rows) == len(packing.token_pieces(docs).collect())
    check_places(rows, 1024)
    assert packing.query(docs.where(F.lit(False))).collect() == []


def test_hot_length_and_clashing_names(spark):
    turn = random.Random(1)
    lengths = [7] * 900 + [turn.randint(1, 64) for _ in range(1500)]
    pieces = spark.createDataFrame([(i % 50, i, 0, n, "s") for i, n in enumerate(lengths)], "doc_id long, row_key long, piece int, length long, sequence_id string")
    rows = packing.pack(pieces, 64).collect()
    assert len(rows) == len(lengths)
    assert check_places(rows, 64) <= 1.01 * sum(lengths) / 64


def fewest(lengths, capacity):
    """Exact number of sequences, by search."""
    best = [len(lengths)]
    lengths = sorted(lengths, reverse=True)

    def place(i, free):
        if len(free) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(free)
            return
        for j in {f: j for j, f in enumerate(free)}.values():
            if free[j] >= lengths[i]:
                place(i + 1, free[:j] + [free[j] - lengths[i]] + free[j + 1 :])
        place(i + 1, [*free, capacity - lengths[i]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(40))
def test_reduction_keeps_the_optimum(seed):
    turn = random.Random(seed)
    capacity = turn.choice([10, 20, 30])
    lengths = [turn.randint(1, capacity) for _ in range(turn.randint(1, 9))]
    counts = {x: lengths.count(x) for x in lengths}
    left = dict(counts)
    fixed = packing.dominated(left, capacity)
    rest = [x for x, n in left.items() for _ in range(n)]
    assert sorted(rest + [x for p, n in fixed for x in p * n]) == sorted(lengths)
    assert sum(n for _, n in fixed) + fewest(rest, capacity) == fewest(lengths, capacity)
    plan = packing.plan_sequences(counts, capacity)
    assert all(sum(p) <= capacity for p, _ in plan)
    assert sorted(x for p, n in plan for x in p * n) == sorted(lengths)


def test_bad_lengths():
    with pytest.raises(ValueError):
        packing.plan_sequences({0: 1}, 10)
    with pytest.raises(ValueError):
        packing.plan_sequences({11: 1}, 10)
