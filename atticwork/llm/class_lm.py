"""Language-model scoring with Brown class n-grams: exchange clustering, class transitions, word emissions."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, crc_fold, mix64, partitions_for, per_batch, record, shuffled_once, tailed_blocks, written

#: Words that are clustered first, one by one; all other words wait in units of equal endings.
OWN_WORDS = 4096
ENDINGS = 1024
ENDING_BYTES = 3
#: Occurrences in training from which on a word beyond those is moved by its own contexts; rarer and unseen words keep
#: the class of their ending.
OWN_COUNT = 3
CLASSES = 48
#: Rounds of exchange at least; they go on as long as the information rises.
ROUNDS = 7
PAGE_WORDS = 150_000
GROUP_WORDS = 1_000_000
#: Words whose contexts are laid out at once.
STEP_WORDS = 8192
#: Rows that go to Python at once: texts, and pages of about a megabyte.
TEXT_ROWS, PAGE_ROWS = 500, 4
ADDED = 0.1
PRIOR = 5.0
_END = np.uint64(0x1B873593CC9E2D51)
_ROWS = 64  # rows of a count matrix that travel together

_PAGE = pa.schema(
    [("page", pa.int64()), ("ids", pa.list_(pa.int64())), ("training", pa.binary()), ("lengths", pa.binary()), ("stream", pa.binary()), ("words", pa.binary()), ("endings", pa.binary()), ("counts", pa.binary())]
)
_PAGE_DDL = "page long, ids array<long>, training binary, lengths binary, stream binary, words binary, endings binary, counts binary"


def _planes(values: np.ndarray) -> bytes:
    """Small numbers as three planes of bytes; the upper ones are nearly all zero and pack well."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    low, middle, high = np.frombuffer(raw, np.uint8).reshape(3, -1).astype(np.int64)
    return low | middle << 8 | high << 16


def pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """The token streams of all texts in pages of about PAGE_WORDS tokens with a dictionary each.

    Tokens are words in lower case (A-Z) and one end per document. Dictionary entries stand by falling frequency in the
    page; ``counts`` are those in the page's training documents (fold not 0).
    """

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        held: list[tuple] = []
        for at, to, offsets, words, tails in tailed_blocks(batch, "text", ENDING_BYTES):
            held.append((at, to, np.diff(offsets), words, tails))
            if sum(len(h[3]) for h in held) >= PAGE_WORDS:
                yield page(batch, held)
                held = []
        if held:
            yield page(batch, held)

    def page(batch: pa.RecordBatch, held: list[tuple]) -> dict:
        at, to = held[0][0], held[-1][1]
        lengths = np.concatenate([h[2] for h in held]) + 1
        ends = np.cumsum(lengths) - 1
        tokens = np.full(int(lengths.sum()), _END, np.uint64)
        endings = np.zeros(len(tokens), np.uint16)
        inner = np.ones(len(tokens), bool)
        inner[ends] = False
        tokens[inner] = np.concatenate([h[3] for h in held])
        endings[inner] = (np.concatenate([h[4] for h in held]) >> np.uint64(40)) % np.uint64(ENDINGS)
        training = batch.column(1).slice(at, to - at).to_numpy(zero_copy_only=False).astype(bool)
        words, first, local, seen = np.unique(tokens, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(-seen, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        local = place[local]
        counts = np.bincount(local[np.repeat(training, lengths)], minlength=len(words))
        return {
            "page": [int.from_bytes(os.urandom(8), "little") >> 1], "ids": [batch.column(0).slice(at, to - at).to_pylist()],
            "training": [training.tobytes()], "lengths": [lengths.astype("<i8").tobytes()], "stream": [_planes(local)],
            "words": [words[order].tobytes()], "endings": [endings[first[order]].tobytes()], "counts": [counts.astype("<u4").tobytes()],
        }

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), (crc_fold(F.col(id_col), folds) != 0).alias("training"), F.col(text_col).alias("text"))
    return source.mapInArrow(per_batch(run, _PAGE), _PAGE_DDL)


def _part_of(words: np.ndarray, parts: int) -> np.ndarray:
    return ((words >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _dealt(words: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the words by part of the vocabulary, and where each part starts in it."""
    part = _part_of(words, parts)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _summed(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known, local = np.unique(words, return_inverse=True)
    total = np.zeros(len(known), np.int64)
    np.add.at(total, local, counts)
    return known, total


def common_words(stored: DataFrame, parts: int, most: int = OWN_WORDS) -> np.ndarray:
    """Hashes of the commonest training words, most frequent first, ends left out.

    Each task adds up its pages before the shuffle, each part of the vocabulary sends its own commonest words, so none is missed.
    """
    schema = pa.schema([("part", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())])
    tops = pa.schema([("word", pa.int64()), ("n", pa.int64())])

    def send(words: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        order, bounds = _dealt(words, parts)
        some = np.flatnonzero(np.diff(bounds))
        cut = [order[bounds[p] : bounds[p + 1]] for p in some]
        return record({"part": some, "words": [words[c].tobytes() for c in cut], "counts": [counts[c].astype("<i8").tobytes() for c in cut]}, schema)

    def run(batches):
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                own, n = np.frombuffer(batch.column(0)[i].as_py(), "<u8"), np.frombuffer(batch.column(1)[i].as_py(), "<u4")
                words, counts = _summed(np.concatenate([words, own[n > 0]]), np.concatenate([counts, n[n > 0]]))
                if len(words) >= GROUP_WORDS:
                    yield send(words, counts)
                    words, counts = words[:0], counts[:0]
        yield send(words, counts)

    def add(table: pa.Table) -> pa.Table:
        join = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        words, counts = _summed(join("words", "<u8"), join("counts", "<i8"))
        words, counts = words[words != _END], counts[words != _END]
        top = np.lexsort((words.view(np.int64), -counts))[:most]
        return pa.Table.from_batches([record({"word": words[top].view(np.int64), "n": counts[top]}, tops)])

    with arrow_rows(stored.sparkSession, PAGE_ROWS), shuffled_once(stored.sparkSession):
        summed = stored.select("words", "counts").mapInArrow(run, "part int, words binary, counts binary").groupBy("part").applyInArrow(add, "word long, n long")
        rows = summed.orderBy(F.desc("n"), "word").limit(most).collect()
    return np.array([r.word for r in rows], dtype=np.int64).view(np.uint64)


@dataclass
class Units:
    """What is clustered first: unit 0 is the end, then words of their own, then endings; classes: class of each unit;
    bigrams: how often each class follows each other one. own: sorted hashes of the own words, with their units."""

    own: np.ndarray
    own_units: np.ndarray
    classes: np.ndarray
    bigrams: np.ndarray

    def of(self, words: np.ndarray, endings: np.ndarray) -> np.ndarray:
        unit = 1 + len(self.own) + endings.astype(np.int64)
        if len(self.own):
            at = np.minimum(np.searchsorted(self.own, words), len(self.own) - 1)
            unit = np.where(self.own[at] == words, self.own_units[at], unit)
        return np.where(words == _END, 0, unit)


def _neighbours(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class before and after each token of whole documents; the end is the only token of class 0."""
    before = np.concatenate([[0], kinds[:-1]])  # each document follows an end
    after = np.concatenate([kinds[1:], [0]])
    after[kinds == 0] = 0
    return before, after


def _contexts(stored: DataFrame, units: Units) -> tuple[np.ndarray, np.ndarray]:
    """Over all training documents, for each unit: how often each class stands before it and after it.

    The matrices have a fixed size; each task adds up its pages and sends the rows that are not empty, which are summed
    by blocks of rows.
    """
    shared = stored.sparkSession.sparkContext.broadcast(units)
    schema = pa.schema([("block", pa.int32()), ("counts", pa.binary())])
    size = len(units.classes)

    def run(batches):
        units = shared.value
        total = np.zeros((2, size * CLASSES), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                training, lengths, stream, words, endings = (batch.column(j)[i].as_py() for j in range(5))
                unit = units.of(np.frombuffer(words, "<u8"), np.frombuffer(endings, "<u2"))[_from_planes(stream)]
                unit = unit[np.repeat(np.frombuffer(training, bool), np.frombuffer(lengths, "<i8"))]
                if len(unit):
                    for side, context in enumerate(_neighbours(units.classes[unit])):
                        total[side] += np.bincount(unit * CLASSES + context, minlength=size * CLASSES)
        blocks, counts = [], []
        both = total.reshape(2, size, CLASSES)
        for b in range(-(-size // _ROWS)):
            part = both[:, b * _ROWS : (b + 1) * _ROWS]
            if part.any():
                blocks.append(b)
                counts.append(part.astype("<i8").tobytes())
        yield record({"block": blocks, "counts": counts}, schema)

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<i8") for x in table.column("counts").to_pylist())
        return pa.table({"block": [table.column("block")[0].as_py()], "counts": [total.tobytes()]}, schema=schema)

    with arrow_rows(stored.sparkSession, PAGE_ROWS), shuffled_once(stored.sparkSession):
        rows = (
            stored.select("training", "lengths", "stream", "words", "endings")
            .mapInArrow(run, "block int, counts binary")
            .groupBy("block")
            .applyInArrow(add, "block int, counts binary")
            .collect()
        )
    out = np.zeros((2, size, CLASSES), np.int64)
    for block, counts in rows:
        part = np.frombuffer(counts, "<i8").reshape(2, -1, CLASSES)
        out[:, block * _ROWS : block * _ROWS + part.shape[1]] = part
    return out[0], out[1]


def _information(bigrams: np.ndarray) -> float:
    """Mutual information of neighbouring classes, up to constants."""
    n = bigrams.astype(float)
    rows, columns = n.sum(1), n.sum(0)
    log = lambda x: np.log(np.where(x > 0, x, 1.0))
    return float((n * log(n)).sum() - (rows * log(rows)).sum() - (columns * log(columns)).sum())


def _best_class(before: np.ndarray, after: np.ndarray, bigrams: np.ndarray) -> np.ndarray:
    """For each row of context counts the class with the greatest gain in information, the contexts held; never the end's."""
    n = bigrams.astype(float)
    log = np.log(n + 0.5) - np.log(n.sum(1, keepdims=True) + 1) - np.log(n.sum(0, keepdims=True) + 1)
    gain = before @ log + after @ log.T
    gain[:, 0] = -np.inf
    return gain.argmax(1)


def _bigrams(before: np.ndarray, classes: np.ndarray) -> np.ndarray:
    out = np.zeros((CLASSES, CLASSES), np.int64)
    np.add.at(out.T, classes, before)
    return out


def _exchange(before: np.ndarray, after: np.ndarray, classes: np.ndarray, turn: int) -> np.ndarray:
    """Moves units to their best class; a third waits each round, so that neighbours don't swap for ever. The end stays
    alone in class 0."""
    best = _best_class(before, after, _bigrams(before, classes))
    waits = mix64(np.arange(len(classes), dtype=np.uint64) + np.uint64(turn * 1_000_003)) % np.uint64(3) == 0
    moved = np.where(waits | ((before.sum(1) + after.sum(1)) == 0), classes, best)
    moved[0] = 0
    return moved


def cluster(stored: DataFrame, words: np.ndarray) -> Units:
    """Exchange clustering of the end, the given words and the endings of all others, over all training tokens."""
    order = np.argsort(words)
    # Start: own words by rank, endings by number, dealt in turn.
    deal = lambda n: 1 + np.arange(n) % (CLASSES - 1)
    now = Units(words[order], 1 + order, np.concatenate([[0], deal(len(words)), deal(ENDINGS)]), np.zeros((CLASSES, CLASSES), np.int64))
    chosen: tuple[float, Units] | None = None
    for turn in count():
        before, after = _contexts(stored, now)
        now = replace(now, bigrams=_bigrams(before, now.classes))
        value = _information(now.bigrams)
        rises = chosen is None or value > chosen[0]
        if rises:
            chosen = (value, now)
        if turn >= ROUNDS and not rises:
            break
        now = replace(now, classes=_exchange(before, after, now.classes, turn))
    assert chosen is not None
    return chosen[1]


_ASKED = pa.schema(
    [("part", pa.int32()), ("page", pa.int64()), ("words", pa.binary()), ("endings", pa.binary()), ("counts", pa.binary()), ("before", pa.binary()), ("after", pa.binary())]
)
_ASKED_DDL = "part int, page long, words binary, endings binary, counts binary, before binary, after binary"
_LONGS = pa.list_(pa.int64())
_ANSWER = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("page", pa.int64()), ("counts", pa.binary()), ("classes", pa.binary()), ("x", _LONGS), ("y", _LONGS)])
_ANSWER_DDL = "kind int, part int, page long, counts binary, classes binary, x array<long>, y array<long>"


def _ask(parts: int, shared):
    """Per page and part of the vocabulary: the words, their counts in training, and for each training token of a word
    beyond the own ones, in the order of the words, the classes before and after it."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        units: Units = shared.value
        for i in range(batch.num_rows):
            page, training, lengths, stream, words, endings, counts = (batch.column(j)[i].as_py() for j in range(7))
            words, endings, counts = np.frombuffer(words, "<u8"), np.frombuffer(endings, "<u2"), np.frombuffer(counts, "<u4")
            unit = units.of(words, endings)
            free = unit > len(units.own)
            order, bounds = _dealt(words, parts)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            local = _from_planes(stream)[np.repeat(np.frombuffer(training, bool), np.frombuffer(lengths, "<i8"))]
            contexts = [np.zeros(0, np.uint8)] * 2
            if len(local):
                use = np.flatnonzero(free[local])
                use = use[np.argsort(place[local[use]], kind="stable")]
                contexts = [c[use].astype(np.uint8) for c in _neighbours(units.classes[unit][local])]
            upto = np.concatenate([[0], np.cumsum(np.where(free, counts, 0)[order], dtype=np.int64)])
            out: dict[str, list] = {n: [] for n in _ASKED.names}
            for p in np.flatnonzero(np.diff(bounds)):
                own = order[bounds[p] : bounds[p + 1]]
                a, b = upto[bounds[p]], upto[bounds[p + 1]]
                values = (int(p), page, words[own].tobytes(), endings[own].tobytes(), counts[own].tobytes(), contexts[0][a:b].tobytes(), contexts[1][a:b].tobytes())
                for name, value in zip(_ASKED.names, values, strict=True):
                    out[name].append(value)
            yield out

    return run


def _answer(shared):
    """For one part of the vocabulary: kind 0 rows with the training count and the class of each word that a page asked
    for, one kind 1 row with tokens and distinct words per class.

    Every word from OWN_COUNT occurrences on that is not clustered yet moves to the best class for all its contexts."""

    def run(table: pa.Table) -> pa.Table:
        units: Units = shared.value
        pages_, raw = table.column("page").to_pylist(), table.column("words").to_pylist()
        bounds = np.concatenate([[0], np.cumsum([len(x) // 8 for x in raw])]).astype(np.int64)
        join = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        known, first, local = np.unique(np.frombuffer(b"".join(raw), "<u8"), return_index=True, return_inverse=True)
        del raw
        counts, ending = join("counts", "<u4"), join("endings", "<u2")[first]
        totals = np.bincount(local, counts, len(known)).astype(np.int64)
        unit = units.of(known, ending)
        classes, free = units.classes[unit], unit > len(units.own)

        word = np.repeat(local, np.where(free[local], counts, 0).astype(np.int64))
        order = np.argsort(word, kind="stable")
        word, before, after = word[order], join("before", np.uint8)[order], join("after", np.uint8)[order]
        for at in range(0, len(known), STEP_WORDS):
            to = min(at + STEP_WORDS, len(known))
            a, b = np.searchsorted(word, (at, to))
            sums = [np.bincount((word[a:b] - at) * CLASSES + c[a:b], minlength=(to - at) * CLASSES).reshape(-1, CLASSES) for c in (before, after)]
            moves = free[at:to] & (totals[at:to] >= OWN_COUNT)
            classes[at:to] = np.where(moves, _best_class(*sums, units.bigrams), classes[at:to])

        part, n, seen = table.column("part")[0].as_py(), len(pages_), totals > 0
        answers, kinds = np.minimum(totals, 0xFFFFFFFF).astype("<u4")[local], classes.astype(np.uint8)[local]
        cuts = list(zip(bounds[:-1], bounds[1:], strict=True))
        out: dict[str, list] = {
            "kind": [0] * n + [1], "part": [part] * (n + 1), "page": [*pages_, -1],
            "counts": [*(answers[a:b].tobytes() for a, b in cuts), None], "classes": [*(kinds[a:b].tobytes() for a, b in cuts), None],
            "x": [None] * n + [np.bincount(classes, totals, CLASSES).astype(np.int64)],
            "y": [None] * n + [np.bincount(classes[seen], minlength=CLASSES)],
        }
        return pa.Table.from_batches([record(out, _ANSWER)])

    return run


@dataclass
class ClassTotals:
    """Training tokens and distinct training words per class."""

    tokens: np.ndarray
    words: np.ndarray


def class_totals(answers: DataFrame) -> ClassTotals:
    rows = answers.where("kind = 1").select(F.posexplode(F.arrays_zip("x", "y")).alias("i", "v")).groupBy("i").agg(F.sum("v.x"), F.sum("v.y")).collect()
    tokens, words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for i, t, w in rows:
        tokens[i], words[i] = t, w
    return ClassTotals(tokens, words)


_STREAM = pa.schema(
    [("doc_id", pa.int64()), ("training", pa.bool_()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("emission", pa.float64()), ("classes", pa.binary())]
)
_STREAM_DDL = "doc_id long, training boolean, n_known long, base_score double, emission double, classes binary"


def _per_document(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, np.concatenate([[0], np.cumsum(lengths)])[:-1])


def _classed(shared):
    """One page with its answers: per document the class of each token, and what it scores without transitions."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        totals: ClassTotals = shared.value
        ids, training, lengths, stream, dealt, kind = (left.column(c)[0].as_py() for c in ("ids", "training", "lengths", "stream", "dealt", "dealt_as"))
        lengths, local = np.frombuffer(lengths, "<i8"), _from_planes(stream)
        order = np.argsort(np.frombuffer(dealt, kind), kind="stable")
        by_part = sorted(zip(*(right.column(c).to_pylist() for c in ("part", "counts", "classes")), strict=True))
        counts, classes = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        counts[order] = np.frombuffer(b"".join(c for _, c, _ in by_part), "<u4")
        classes[order] = np.frombuffer(b"".join(c for _, _, c in by_part), np.uint8)
        base = np.log10(counts + ADDED) - np.log10(totals.tokens.sum() + ADDED * (totals.words.sum() + 1))
        emission = np.log10(counts + ADDED) - np.log10(totals.tokens[classes] + ADDED * (totals.words[classes] + 1))
        per_document = lambda values: _per_document(values[local], lengths)
        kinds = classes.astype(np.uint8)[local].tobytes()
        ends = np.cumsum(lengths)
        row = {
            "doc_id": ids, "training": np.frombuffer(training, bool), "n_known": per_document((counts > 0).astype(np.int64)),
            "base_score": per_document(base), "emission": per_document(emission),
            "classes": [kinds[b - n : b] for n, b in zip(lengths, ends, strict=True)],
        }
        return pa.Table.from_batches([record(row, _STREAM)])

    return run


def transitions(streams: DataFrame) -> np.ndarray:
    """How often each class follows each other one in training documents."""
    schema = pa.schema([("counts", _LONGS)])

    def run(batches):
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            kinds = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).astype(np.int64)
            if len(kinds):
                total += np.bincount(_neighbours(kinds)[0] * CLASSES + kinds, minlength=len(total))
        yield record({"counts": [total]}, schema)

    with arrow_rows(streams.sparkSession, TEXT_ROWS), shuffled_once(streams.sparkSession):
        rows = (
            streams.where("training").select("classes").mapInArrow(run, "counts array<long>")
            .select(F.posexplode("counts").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()
        )
    out = np.zeros(CLASSES * CLASSES, np.int64)
    for i, n in rows:
        out[i] = n
    return out.reshape(CLASSES, CLASSES)


def smoothed(bigrams: np.ndarray) -> np.ndarray:
    """log10 probability of a class after another one, smoothed with the share of the class."""
    share = (bigrams.sum(0) + 1) / (bigrams.sum() + CLASSES)
    return np.log10((bigrams + PRIOR * share) / (bigrams.sum(1, keepdims=True) + PRIOR))


_SCORE = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score(shared, tokens: int):
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        streams = batch.column(5).to_pylist()
        lengths = np.array([len(x) for x in streams], np.int64)
        kinds = np.frombuffer(b"".join(streams), np.uint8).astype(np.int64)
        if len(lengths):
            moves = _per_document(shared.value[_neighbours(kinds)[0], kinds], lengths)
            yield {
                "doc_id": batch.column(0), "held_out": ~batch.column(1).to_numpy(zero_copy_only=False), "n_tokens": lengths, "n_known": batch.column(2),
                "train_tokens": np.full(len(lengths), tokens), "base_score": batch.column(3), "score": moves + batch.column(4).to_numpy(),
            }

    return run


def class_streams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, own_words: int = OWN_WORDS) -> tuple[DataFrame, ClassTotals]:
    """One row per document with the class of each of its tokens, a byte each, and the totals of the classes."""
    spark = docs.sparkSession
    with arrow_rows(spark, TEXT_ROWS):
        stored = written(pages(docs, id_col, text_col, folds), "pages")
    entries = stored.agg(F.sum(F.length("words") / 8)).first()[0] or 0
    parts = partitions_for(spark, entries, GROUP_WORDS)
    units = spark.sparkContext.broadcast(cluster(stored, common_words(stored, parts, own_words)))
    with arrow_rows(spark, PAGE_ROWS):
        asked = stored.select("page", "training", "lengths", "stream", "words", "endings", "counts").mapInArrow(per_batch(_ask(parts, units), _ASKED), _ASKED_DDL)
        answers = written(asked.groupBy("part").applyInArrow(_answer(units), _ANSWER_DDL), "answers")
        totals = class_totals(answers)
        right = answers.where("kind = 0").select("page", "part", "counts", "classes").groupBy("page")
        left = _with_parts(stored, parts).groupBy("page")
        shared = spark.sparkContext.broadcast(totals)
        return written(left.cogroup(right).applyInArrow(_classed(shared), _STREAM_DDL), "classes"), totals


def _with_parts(stored: DataFrame, parts: int) -> DataFrame:
    """The pages with the part of each word in place of its hash, which takes a byte or two."""
    kept = ["page", "ids", "training", "lengths", "stream"]
    schema = pa.schema([_PAGE.field(n) for n in kept] + [("dealt", pa.binary()), ("dealt_as", pa.string())])
    kind = np.min_scalar_type(parts)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        dealt = [_part_of(np.frombuffer(w, "<u8"), parts).astype(kind).tobytes() for w in batch.column(5).to_pylist()]
        yield {n: batch.column(i) for i, n in enumerate(kept)} | {"dealt": dealt, "dealt_as": [kind.str] * len(dealt)}

    ddl = "page long, ids array<long>, training binary, lengths binary, stream binary, dealt binary, dealt_as string"
    return stored.select(*kept, "words").mapInArrow(per_batch(run, schema), ddl)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, own_words: int = OWN_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) per row of docs.

    score is the log10 probability of the whole text under p(class | class before) * p(word | class), learned from the
    documents whose crc32(id as text) modulo folds is not 0. Transitions are smoothed with the class frequencies,
    emissions as the base score is: log10((c + 0.1) / (N + 0.1 (V + 1))), within the class. A word that training does
    not know takes the class of its ending. base_score is the same without classes. perplexity is per token.

    Each document's tokens are its words (A-Z in lower case) and one end; a null or empty text is the end alone. Repeated rows
    are scored each; a null id counts as the empty text in the fold. Without training documents all scores are those of
    the smoothing alone. An empty table gives an empty table.

    The vocabulary stays dealt by hash; pages of text ask it for the counts and classes of their distinct words. Exchange
    clustering runs in two levels. The own_words commonest words, and all others in units of equal endings, are exchanged
    round by round. Then every other word with at least OWN_COUNT occurrences moves by all its own contexts, which are
    sent to its part of the vocabulary; only rarer and unseen words keep the class of their ending. Transitions and
    emissions are counted after that over all training tokens.
    """
    spark = docs.sparkSession
    streams, totals = class_streams(docs, id_col, text_col, folds, own_words)
    shared = spark.sparkContext.broadcast(smoothed(transitions(streams)))
    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    with arrow_rows(spark, TEXT_ROWS):
        scored = written(streams.mapInArrow(per_batch(_score(shared, int(totals.tokens.sum())), _SCORE), ddl), "scores")
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def query(docs: DataFrame) -> DataFrame:
    return score_texts(docs.select("doc_id", "text"))
