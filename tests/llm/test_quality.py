import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from atticwork.llm import quality


def made(n=600, seed=3):
    turn = random.Random(seed)
    word = lambda: "".join(turn.choice("abcdefghij") for _ in range(turn.randint(2, 8)))
    rows, labels = [], []
    for i in range(n):
        good = turn.random() < 0.7
        words = [word() if good else word().upper() + "!!" for _ in range(turn.randint(5, 60))]
        rows.append((i, " ".join(words), f"s{i % 3}"))
        if turn.random() < 0.8:
            labels.append((i, int(good)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = made()
    extra = [(9001, None, "x"), (9002, "", "x"), (9003, "\n", "x"), (9004, "long word " * 40_000, "x"), (5, rows[5][1], "x"), (None, "no id", "x")]
    odd = [(1, None), (2, 7), (labels[3][0], labels[3][1]), (labels[4][0], 1 - labels[4][1]), (None, 1)]
    return spark.createDataFrame(rows + extra, "doc_id long, text string, score string"), spark.createDataFrame(labels + odd, "doc_id long, quality int")


def test_held_out_rows(tables):
    docs, labels = tables
    rows = quality.query(docs, labels).collect()
    assert len(rows) == docs.count()
    truth = dict(made()[1])
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
    judged = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in judged) / len(judged) > 0.97


def test_labels_outside_training_do_not_matter(tables):
    docs, labels = tables
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {(r.doc_id, r.score) for r in quality.query(docs, labels).collect()}
    assert a == {(r.doc_id, r.score) for r in quality.query(docs, flipped).collect()}


def test_one_label_none_and_empty(spark, tables):
    docs, labels = tables
    few = docs.limit(20)
    only = quality.query(few, labels.where("quality = 1")).collect()
    assert len({r.score for r in only}) == 1 and only[0].score > 0.5
    none = quality.query(few, labels.where(F.lit(False))).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.query(docs.where(F.lit(False)), labels).collect() == []


def test_columns_pass(tables):
    docs, labels = tables
    out = quality.score_quality(docs.withColumn("label", F.lit(1)), quality.fit(docs, quality.labelled_sample(labels)))
    assert out.columns == ["doc_id", "text", "label", "score", "predicted"]
    assert dict(out.dtypes)["score"] == "double"


def grams(text):
    """Distinct word one- and two-grams and shape one- to five-grams, as the module describes them."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))
    kinds = ["a" if 97 <= b <= 122 or b > 127 else "A" if 65 <= b <= 90 else "1" if 48 <= b <= 57 else " " if b in (9, 11, 12, 13) else chr(b) for b in text.encode()]
    shape = [k for i, k in enumerate(kinds) if not i or kinds[i - 1] != k]
    return {("w", w) for w in words} | {("ww", *p) for p in zip(words, words[1:])} | {("s", *shape[i : i + n]) for n in range(1, 6) for i in range(len(shape) - n + 1)}


def test_indicators_are_the_distinct_n_grams():
    turn = random.Random(6)
    texts = ["".join(turn.choice("abCD 12.,!\n\té-") for _ in range(turn.randint(0, 60))) for _ in range(200)] + ["", "one", " \n", "word " * 30_000]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    found = [set() for _ in texts]
    for at, to, owner, feature in quality.indicators(batch, "text", bits=40):
        assert len(owner) == len(feature)
        for i, f in zip(owner.tolist(), feature.tolist()):
            assert f not in found[at + i]
            found[at + i].add(f)
    plain = [grams(t) for t in texts]
    assert [len(f) for f in found] == [len(g) for g in plain]
    for i in range(0, 200, 2):  # shared n-grams are shared features
        assert len(found[i] & found[i + 1]) == len(plain[i] & plain[i + 1])


def plain_fit(rows, labels, keys):
    """Naive Bayes ratios and dual coordinate descent with dicts, document by document; rows: sets of features."""
    order = sorted(range(len(rows)), key=lambda i: keys[i])
    training = [i for n, i in enumerate(order) if n % 5]
    good, bad = [i for i in training if labels[i] == 1], [i for i in training if labels[i] != 1]
    ratio = {}
    for f in set().union(*rows):
        p, q = quality.SMOOTHING + sum(f in rows[i] for i in good), quality.SMOOTHING + sum(f in rows[i] for i in bad)
        ratio[f] = math.log(p / (quality.SMOOTHING + len(good))) - math.log(q / (quality.SMOOTHING + len(bad)))
    x = [{f: ratio[f] / math.sqrt(max(1, len(r))) for f in r} for r in rows]
    share = len(good) / len(training)
    alpha, w, bias = [0.0] * len(rows), dict.fromkeys(ratio, 0.0), 0.0
    turn = np.random.default_rng(3)
    for _ in range(quality.EPOCHS):
        moved = 0.0
        for i in turn.permutation(training):
            sign = 1.0 if labels[i] == 1 else -1.0
            most = quality.PENALTY * (0.5 / share if sign > 0 else 0.5 / (1 - share))
            gradient = sign * (sum(w[f] * v for f, v in x[i].items()) + bias) - 1
            new = min(max(alpha[i] - gradient / (sum(v * v for v in x[i].values()) + 1), 0.0), most)
            step, alpha[i] = (new - alpha[i]) * sign, new
            for f, v in x[i].items():
                w[f] += step * v
            bias += step
            moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return ratio, x, w, bias, alpha, share


def cases(n=120, seed=4):
    turn = random.Random(seed)
    labels = [turn.randint(0, 1) for _ in range(n)]
    rows = [sorted({turn.randint(0, 40) + 15 * y * turn.randint(0, 1) for _ in range(turn.randint(0, 12))}) for y in labels]
    keys = turn.sample(range(-5000, 5000), n)
    arrays = (np.array([len(r) for r in rows], np.int32), np.array([f for r in rows for f in r], np.int32), np.array(labels, np.int8), np.array(keys, np.int64))
    return [set(r) for r in rows], labels, keys, arrays


def test_weights_are_those_of_a_plain_fit():
    rows, labels, keys, arrays = cases()
    model = quality.fit_arrays(*arrays)
    ratio, _, w, bias, _, _ = plain_fit(rows, labels, keys)
    mean = sum(map(abs, w.values())) / (1 << quality.BITS)
    want = np.zeros(1 << quality.BITS)
    for f, r in ratio.items():
        want[f] = ((1 - quality.MIXED) * mean + quality.MIXED * w[f]) * r
    used = np.zeros(len(want), bool)
    used[list(ratio)] = True
    assert np.abs(model.weights[used] - want[used]).max() < 1e-8 and model.bias == pytest.approx(bias, abs=1e-8)
    assert np.abs(want).max() > 0.01


def test_descent_reaches_the_least_hinge_loss(monkeypatch):
    """Primal and dual value meet, so the descent solves its problem."""
    monkeypatch.setattr(quality, "EPOCHS", 3000)
    rows, labels, keys, arrays = cases()
    _, x, w, bias, alpha, share = plain_fit(rows, labels, keys)
    order = sorted(range(len(rows)), key=lambda i: keys[i])
    loss = 0.0
    for i in (i for n, i in enumerate(order) if n % 5):
        sign = 1.0 if labels[i] == 1 else -1.0
        loss += (0.5 / share if sign > 0 else 0.5 / (1 - share)) * max(0.0, 1 - sign * (sum(w[f] * v for f, v in x[i].items()) + bias))
    size = (sum(v * v for v in w.values()) + bias * bias) / 2
    assert size + quality.PENALTY * loss == pytest.approx(sum(alpha) - size, rel=0.02)
    _, features, *_ = arrays
    assert np.allclose(quality.fit_arrays(*arrays).weights[np.unique(features)].sum(), sum(quality.MIXED * w[f] * r + (1 - quality.MIXED) * sum(map(abs, w.values())) / (1 << quality.BITS) * r for f, r in plain_fit(rows, labels, keys)[0].items()))
