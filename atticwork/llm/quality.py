"""Quality classifier: naive Bayes support vectors on n-gram indicators, fitted by dual coordinate descent."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _bytes_of, add_columns, crc_fold, mix64, per_batch, text_batches, word_blocks

BITS = 18
#: Upper bound of the labelled rows that the model is fitted on, drawn by a hash of their id.
SAMPLE_ROWS = 12_000
SMOOTHING = 1.0
PENALTY = 1.0
#: Share of the naive Bayes weights in the final weights: w' = (1 - MIXED) * mean |w| + MIXED * w.
MIXED = 0.75
EPOCHS = 15
THRESHOLD = 0.3

# Classes of bytes for shape n-grams: letters fold to two classes, digits to one, all other ASCII stays itself.
_SHAPE = np.arange(256, dtype=np.uint64) + np.uint64(1)
_SHAPE[128:] = _SHAPE[97:123] = 98
_SHAPE[65:91] = 66
_SHAPE[48:58] = 49
_SHAPE[[9, 11, 12, 13]] = 33


def indicators(batch: pa.RecordBatch, text: str, bits: int = BITS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, row of each feature, feature): distinct hashed n-grams of each whole text.

    Word one- and two-grams in lower case, and one- to five-grams over the shape of the text, in which a run of
    characters of one class (lower case or non-ASCII, upper case, digit, each other sign) counts once.
    """
    data, bounds = _bytes_of(batch.column(batch.schema.get_field_index(text)))
    for at, to, offsets, words in word_blocks(batch, text):
        rows = np.repeat(np.arange(to - at), np.diff(offsets))
        owners, codes = [rows], [words]
        if len(words) > 1:
            two = np.flatnonzero(rows[1:] == rows[:-1])
            owners.append(rows[two])
            codes.append(mix64(words[two] * np.uint64(3) + words[two + 1]))
        shape, owner = _shapes(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
        for n in range(1, 6):
            m = len(shape) - n + 1
            if m <= 0:
                break
            code = np.full(m, n, np.uint64)
            for j in range(n):
                code = code * np.uint64(521) + shape[j : j + m]
            inside = owner[:m] == owner[n - 1 :]
            owners.append(owner[:m][inside])
            codes.append(code[inside])
        owner = np.concatenate(owners).astype(np.uint64)
        feature = mix64(np.concatenate(codes)) >> np.uint64(64 - bits)
        keys = np.unique(owner << np.uint64(bits) | feature)
        yield at, to, (keys >> np.uint64(bits)).astype(np.int64), (keys & np.uint64((1 << bits) - 1)).astype(np.int64)


def _shapes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each run of alike bytes and the row it stands in."""
    kinds = _SHAPE[data]
    first = np.ones(len(kinds), bool)
    first[1:] = kinds[1:] != kinds[:-1]
    first[bounds[:-1][bounds[:-1] < len(kinds)]] = True
    at = np.flatnonzero(first)
    return kinds[at], np.searchsorted(bounds, at, side="right") - 1


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, batch: pa.RecordBatch, text: str) -> np.ndarray:
        """Probability of label 1 for each row."""
        out = np.empty(batch.num_rows)
        for at, to, owner, feature in indicators(batch, text):
            out[at:to] = np.bincount(owner, self.weights[feature], to - at) / _norm(owner, to - at)
        z = np.clip(self.slope * (out + self.bias) + self.shift, -500, 500)
        return 1 / (1 + np.exp(-z))


def _norm(owner: np.ndarray, rows: int) -> np.ndarray:
    """Documents differ in length by powers of ten; the sum of weights is taken relative to the root of its terms."""
    return np.sqrt(np.maximum(1, np.bincount(owner, minlength=rows)))


def labelled_sample(labels: DataFrame, folds: int = 5, bound: int = SAMPLE_ROWS, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(s_id, label): about `bound` of the labelled rows outside fold 0, drawn by a hash of the id, or all if fewer.

    Ids with two different labels are left out, repeated rows count once.
    """
    usable = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (crc_fold(F.col(id_col), folds) != 0))
        .groupBy(F.col(id_col).alias("s_id"))
        .agg(F.min(label_col).alias("label"), F.max(label_col).alias("other"))
        .where("label = other")
        .select("s_id", F.col("label").cast("int").alias("label"))
    )
    total = usable.count()
    share = min(1.0, 0.97 * bound / total) if total else 1.0
    cut = int(share * (1 << 30))
    return usable.where(F.pmod(F.xxhash64("s_id", F.lit(5)), F.lit(1 << 30)) < cut)


def fit(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Fit on the texts of the sample (s_id, label), whose size is bounded by its maker; it is broadcast.

    The features come to the driver packed, the fit itself is a few seconds of numpy. Without rows of both labels
    the model gives every text the smoothed share of label 1.
    """
    schema = pa.schema([("counts", pa.binary()), ("features", pa.binary()), ("labels", pa.binary()), ("ids", pa.binary())])

    def extract(batch: pa.RecordBatch) -> Iterator[dict]:
        labels = batch.column(1).to_numpy(zero_copy_only=False)
        keys = batch.column(2).to_numpy(zero_copy_only=False)
        for at, to, owner, feature in indicators(batch, "text"):
            yield {
                "counts": [np.bincount(owner, minlength=to - at).astype(np.int32).tobytes()],
                "features": [feature.astype(np.int32).tobytes()],
                "labels": [labels[at:to].astype(np.int8).tobytes()],
                "ids": [keys[at:to].astype(np.int64).tobytes()],
            }

    text_batches(docs.sparkSession)
    picked = docs.join(F.broadcast(sample), docs[id_col] == sample["s_id"]).select(
        F.col(text_col).alias("text"), "label", F.xxhash64("s_id", F.lit(11)).alias("key")
    )
    rows = picked.mapInArrow(per_batch(extract, schema), "counts binary, features binary, labels binary, ids binary").collect()
    counts = np.concatenate([np.frombuffer(r[0], np.int32) for r in rows] or [np.zeros(0, np.int32)])
    features = np.concatenate([np.frombuffer(r[1], np.int32) for r in rows] or [np.zeros(0, np.int32)])
    labels = np.concatenate([np.frombuffer(r[2], np.int8) for r in rows] or [np.zeros(0, np.int8)])
    keys = np.concatenate([np.frombuffer(r[3], np.int64) for r in rows] or [np.zeros(0, np.int64)])
    del rows
    return fit_arrays(counts, features, labels, keys)


def fit_arrays(counts: np.ndarray, features: np.ndarray, labels: np.ndarray, keys: np.ndarray) -> QualityModel:
    starts = np.concatenate([[0], np.cumsum(counts)])
    positive = labels == 1
    if not len(labels) or positive.all() or not positive.any():
        share = (positive.sum() + 1) / (len(labels) + 2)
        return QualityModel(np.zeros(1 << BITS), 0.0, 0.0, float(np.log(share / (1 - share))))
    order = np.argsort(keys, kind="stable")  # the same order on each run, whatever the partitions
    calibration = order[::5]
    training = np.setdiff1d(order, calibration, assume_unique=True)
    training = training[np.argsort(keys[training], kind="stable")]
    if not (positive[training].any() and (~positive[training]).any()):
        training = calibration = order
    in_training = np.zeros(len(labels), bool)
    in_training[training] = True
    size = 1 << BITS
    p, q = np.full(size, SMOOTHING), np.full(size, SMOOTHING)
    for a, b in _chunks(len(labels)):
        own = features[starts[a] : starts[b]]
        for total, label in ((p, positive), (q, ~positive)):
            total += np.bincount(own[np.repeat((in_training & label)[a:b], counts[a:b])], minlength=size)
    ratio = np.log(p / (SMOOTHING + positive[training].sum())) - np.log(q / (SMOOTHING + (~positive[training]).sum()))

    # Dual coordinate descent for hinge loss: one multiplier per document, 0 to PENALTY, weighed by class.
    w, bias = np.zeros(size), 0.0
    alpha = np.zeros(len(labels))
    norm = np.sqrt(np.maximum(1, counts))
    squares = _sums(ratio * ratio, features, starts) / norm**2 + 1
    share = positive[training].mean()
    most = PENALTY * np.where(positive, 0.5 / share, 0.5 / (1 - share))
    sign = np.where(positive, 1.0, -1.0)
    turn = np.random.default_rng(3)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in turn.permutation(training):
            own = features[starts[i] : starts[i + 1]]
            x = ratio[own] / norm[i]
            gradient = sign[i] * (w[own] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / squares[i], 0.0), most[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                alpha[i] = new
                w[own] += step * x
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    weights = ((1 - MIXED) * np.abs(w).mean() + MIXED * w) * ratio

    margin = _sums(weights, features, starts) / norm + bias
    slope, shift = _platt(margin[calibration], positive[calibration])
    return QualityModel(weights, bias, slope, shift)


def _chunks(rows: int, step: int = 500) -> Iterator[tuple[int, int]]:
    return ((a, min(a + step, rows)) for a in range(0, rows, step))


def _sums(weights: np.ndarray, features: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of the weights of each row's features; a few hundred rows at a time, as the driver is small."""
    out = np.empty(len(starts) - 1)
    for a, b in _chunks(len(out)):
        upto = np.concatenate([[0.0], np.cumsum(weights[features[starts[a] : starts[b]]])])
        at = starts[a : b + 1] - starts[a]
        out[a:b] = upto[at[1:]] - upto[at[:-1]]
    return out


def _platt(margin: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through held-back margins, with Platt's smoothed targets, by Newton steps."""
    yes, no = positive.sum(), (~positive).sum()
    target = np.where(positive, (yes + 1) / (yes + 2), 1 / (no + 2))
    x = np.stack([margin, np.ones_like(margin)])
    theta = np.array([1.0, 0.0])
    for _ in range(100):
        z = 1 / (1 + np.exp(-np.clip(theta @ x, -50, 50)))
        gradient = x @ (z - target) + 1e-6 * theta
        hessian = (x * (z * (1 - z) + 1e-9)) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta = theta - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", keep_text: bool = True, threshold: float = THRESHOLD) -> DataFrame:
    """Adds score (0 to 1, higher: label 1 likelier) and predicted (1 from the threshold on) to docs.

    Whole texts are scored; a null text scores as an empty one, from the model's constant terms. The model has a fixed
    size of 2^BITS weights and is broadcast. Repeated rows score alike; other columns pass through, input columns called
    score or predicted are replaced. An empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch) -> list[np.ndarray]:
        score = shared.value.scores(batch, text_col)
        return [score, (score >= threshold).astype(np.int32)]

    return add_columns(docs, text_col, compute, [("score", pa.float64(), "double"), ("predicted", pa.int32(), "int")], keep_text)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labelled_sample(labels))
    return score_quality(
        docs.select("doc_id", (crc_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text"), model, keep_text=False
    )
