import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from atticwork.llm import class_lm

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(UPPER, LOWER)))


def made():
    turn = random.Random(8)
    nouns, verbs, names = ([f"{k}{i}" for i in range(40)] for k in ("nou", "ver", "nam"))
    rows = []
    for i in range(500):
        text = " ".join(f"the {turn.choice(nouns)} {turn.choice(verbs)} {turn.choice(names)} ." for _ in range(turn.randint(1, 12)))
        rows.append((i, text if i % 3 else text.upper()))
    return rows + [(900, None), (901, ""), (902, "\t\n"), (903, "unseen words only"), (904, "the nou1 " * 30_000), (5, rows[5][1]), (None, "no id")]


@pytest.fixture(scope="module")
def scored(spark):
    rows = made()
    return rows, class_lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()


def test_counts_and_base_score(scored):
    rows, found = scored
    training = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0
    counts = Counter()
    for doc, text in rows:
        if training(doc):
            counts.update([*words(text), None])
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for doc, text in rows:
        tokens = [*words(text), None]
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in tokens)
        want.append((doc, not training(doc), len(tokens), sum(counts[t] > 0 for t in tokens), total, round(base, 4)))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_classes_beat_the_base_on_held_out_texts(scored):
    _, found = scored
    held = [r for r in found if r.held_out and r.n_tokens > 10]
    assert held
    assert sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)
    assert all(math.isfinite(r.score) and r.score < 0 and r.perplexity > 1 for r in found)


def training(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 10 != 0


def streams_of(spark, rows, **how):
    """Per row of made() its tokens and their classes."""
    streams, totals = class_lm.class_streams(spark.createDataFrame(rows, "doc_id long, text string"), **how)
    texts = {}
    for doc, text in rows:
        texts.setdefault(doc, [*words(text), None])
    return [(r.doc_id, texts[r.doc_id], list(r.classes)) for r in streams.collect()], totals


@pytest.mark.parametrize("own_words", [class_lm.OWN_WORDS, 25])
def test_scores_are_those_of_a_plain_class_bigram(spark, own_words):
    rows = made()
    streams, totals = streams_of(spark, rows, own_words=own_words)
    class_of, tokens, bigrams = {}, Counter(), Counter()
    for doc, text, classes in streams:
        assert len(text) == len(classes)
        for word, kind in zip(text, classes, strict=True):
            assert class_of.setdefault(word, kind) == kind and (kind == 0) == (word is None)
        if training(doc):
            tokens.update(text)
            bigrams.update(zip([0, *classes[:-1]], classes, strict=True))
    in_class, distinct, after, before = Counter(), Counter(), Counter(), Counter()
    for word, n in tokens.items():
        in_class[class_of[word]] += n
        distinct[class_of[word]] += 1
    for (a, b), n in bigrams.items():
        before[a] += n
        after[b] += n
    assert [in_class[k] for k in range(class_lm.CLASSES)] == list(totals.tokens)
    assert [distinct[k] for k in range(class_lm.CLASSES)] == list(totals.words)
    total = sum(tokens.values())

    def plain(text, classes):
        out, last = 0.0, 0
        for word, kind in zip(text, classes, strict=True):
            share = (after[kind] + 1) / (total + class_lm.CLASSES)
            out += math.log10((bigrams[last, kind] + class_lm.PRIOR * share) / (before[last] + class_lm.PRIOR))
            out += math.log10((tokens[word] + 0.1) / (in_class[kind] + 0.1 * (distinct[kind] + 1)))
            last = kind
        return out

    found = class_lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), own_words=own_words).collect()
    want = sorted(((doc is None, doc or 0, round(plain(text, classes), 4)) for doc, text, classes in streams))
    assert sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 4)) for r in found) == want


def test_words_beyond_the_own_ones_move_by_their_contexts(spark):
    rows = made()
    streams, _ = streams_of(spark, rows, own_words=25)
    class_of, count = {}, Counter()
    for doc, text, classes in streams:
        class_of |= dict(zip(text, classes, strict=True))
        if training(doc):
            count.update(text)
    # By their endings nou1, ver1 and nam1 look alike; by their contexts the three kinds part.
    free = [w for w in count if w and w[:3] in ("nou", "ver", "nam") and count[w] >= class_lm.OWN_COUNT]
    kinds = {}
    for w in free:
        kinds.setdefault(class_of[w], Counter())[w[:3]] += 1
    assert len(free) > 100 and sum(max(c.values()) for c in kinds.values()) >= 0.95 * len(free)


def test_contexts_decide_the_class(spark):
    """The moved words hold the class that a plain sum over their contexts names best."""
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stored = class_lm.written(class_lm.pages(docs), "pages")
    common = class_lm.common_words(stored, 64, 25)
    units = class_lm.cluster(stored, common)
    shared = spark.sparkContext.broadcast(units)
    asked = stored.select("page", "training", "lengths", "stream", "words", "endings", "counts").mapInArrow(
        class_lm.per_batch(class_lm._ask(64, shared), class_lm._ASKED), class_lm._ASKED_DDL
    )
    counts, contexts, classes = Counter(), {}, {}
    for r in asked.collect():
        hashes, n = np.frombuffer(r.words, "<u8"), np.frombuffer(r.counts, "<u4")
        free = units.of(hashes, np.frombuffer(r.endings, "<u2")) > len(units.own)
        at = 0
        for h, c, f in zip(hashes.tolist(), n.tolist(), free.tolist(), strict=True):
            counts[h] += c
            if f:
                one = contexts.setdefault(h, [])
                one += list(zip(r.before[at : at + c], r.after[at : at + c], strict=True))
                at += c
        assert at == len(r.before) == len(r.after)
    assert common.tolist() == [h for h, _ in sorted(((h, n) for h, n in counts.items() if h != int(class_lm._END) and n), key=lambda x: (-x[1], int(np.uint64(x[0]).view(np.int64))))][:25]
    for r in asked.groupBy("part").applyInArrow(class_lm._answer(shared), class_lm._ANSWER_DDL).where("kind = 0").join(asked.select("part", "page", "words"), ["part", "page"]).collect():
        for h, k in zip(np.frombuffer(r.words, "<u8").tolist(), r.classes, strict=True):
            assert classes.setdefault(h, k) == k
    n = units.bigrams.astype(float)
    gain = [[math.log(n[a, b] + 0.5) - math.log(n[a].sum() + 1) - math.log(n[:, b].sum() + 1) for b in range(class_lm.CLASSES)] for a in range(class_lm.CLASSES)]
    moved = [h for h in contexts if counts[h] >= class_lm.OWN_COUNT]
    assert len(moved) > 50
    for h in moved:
        value = [sum(gain[a][k] + gain[k][b] for a, b in contexts[h]) for k in range(class_lm.CLASSES)]
        assert classes[h] != 0 and value[classes[h]] >= max(value[1:]) - 1e-6


def test_transitions_sum_to_one(spark):
    streams, totals = class_lm.class_streams(spark.createDataFrame(made(), "doc_id long, text string"))
    bigrams = class_lm.transitions(streams)
    assert np.allclose((10 ** class_lm.smoothed(bigrams)).sum(1), 1)
    assert (bigrams.sum(0) == totals.tokens).all()


def test_no_training_rows_and_empty(spark):
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = class_lm.query(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert rows[0].train_tokens == 0 and rows[0].base_score == 0 and math.isfinite(rows[0].score)
    assert class_lm.query(spark.createDataFrame(made(), "doc_id long, text string").where(F.lit(False))).collect() == []


def test_exchange_goes_on_while_the_information_rises(spark, monkeypatch):
    values = []
    monkeypatch.setattr(class_lm, "_information", lambda bigrams: values.append(min(len(values), 9)) or float(values[-1]))
    class_lm.score_texts(spark.createDataFrame(made()[:60], "doc_id long, text string"))
    assert values == [*range(10), 9]


def test_shuffles_are_dropped_with_the_job_that_made_them(spark):
    """Disk holds the written tables, not the shuffles of every step beside them."""
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    class_lm.score_texts(spark.createDataFrame(made()[:100], "doc_id long, text string"))
    assert tracker.shuffleStatuses().size() <= before + 1
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
