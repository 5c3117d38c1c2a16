"""What the operators of this subpackage share: written intermediate tables, text helpers in SQL, numpy word hashing."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The setting holds for jobs run inside: it is read when a job is planned and put back afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shuffled_once(spark: SparkSession):
    """Jobs run inside delete their shuffle files as they end; else these stay until the driver collects its garbage. For jobs
    whose frames are not run again."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows of df, written once below spark.checkpoint.dir and read back: later steps survive lost executors, and what was
    shuffled for them is not kept beside them."""
    path = shared_dir(df.sparkSession, purpose)
    with shuffled_once(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_rows(spark: SparkSession, rows: int):
    """Jobs run inside send at most so many rows at once to Python: for rows that are large, such as packed pages."""
    return _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: Texts that go to Python at once.
TEXT_ROWS = 1000


def text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Lower the session's Arrow batches to so many rows: whole texts are kilobytes each, and both sides hold a batch in memory.

    The frames that operators return run later, so the setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def partitions_for(spark: SparkSession, units: int, per_partition: int, least: int = 64) -> int:
    """How many hash groups keep each of them at about per_partition units."""
    return max(least, -(-int(units) // per_partition))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


# --------------------------------------------------------------------------------------------------
# Words in numpy: one pass over the bytes of an Arrow batch, no Python object per word.

#: Bytes of text that are turned into words at once; arrays of eight bytes per text byte stay small.
BLOCK = 1 << 19

_SPACES = np.zeros(256, dtype=bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    high = x >> np.uint64(30)
    x ^= high
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= np.right_shift(x, np.uint64(27), out=high)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= np.right_shift(x, np.uint64(31), out=high)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FOLDED = _BYTE_CODES.copy()
_FOLDED[65:91] = _BYTE_CODES[97:123]
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n + 1:
        size = max(n + 1, BLOCK + 1)
        with np.errstate(over="ignore"):
            up = np.full(size, _BASE, dtype=np.uint64)
            down = np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
            up[0] = down[0] = 1
            np.multiply.accumulate(up, out=up)
            np.multiply.accumulate(down, out=down)
        _powers["up"], _powers["down"] = up, down
    return _powers["up"], _powers["down"]


#: Bytes whose codes are summed at once: they stay in the processor's cache.
_PIECE = 1 << 16


def _hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, codes: np.ndarray, tail: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Hashes of the spans and, for tail > 0, of their last `tail` bytes."""
    up, down = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(data), _PIECE):
            part = codes.take(data[at : at + _PIECE])
            part *= up[at : at + len(part)]
            part[0] += sums[at]
            np.cumsum(part, out=sums[at + 1 : at + 1 + len(part)])

        def hashed(a: np.ndarray) -> np.ndarray:
            return mix64((sums[end] - sums[a]) * down[a] + (end - a).astype(np.uint64))

        return hashed(start), hashed(np.maximum(start, end - tail)) if tail else None


def _word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the words; no word runs over one of the document bounds."""
    inside = ~_SPACES.take(data)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = bounds[(bounds > 0) & (bounds < len(data))]
    first[cuts] |= inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _long_words(data: np.ndarray, codes: np.ndarray, tail: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Word hashes of one long text, window by window; each window ends at white space or at the end."""
    found, at = [], 0
    while at < len(data):
        to = min(len(data), at + BLOCK)
        while to < len(data):
            gaps = np.flatnonzero(_SPACES[data[at:to]])
            if len(gaps):
                to = at + int(gaps[-1]) + 1
                break
            to = min(len(data), to + BLOCK)
        part = data[at:to]
        start, end = _word_spans(part, np.array([0, len(part)]))
        found.append(_hash_spans(part, start, end, codes, tail))
        at = to
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]) if tail else None


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def word_blocks(batch: pa.RecordBatch, text: str, fold: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word offsets per row, word hashes) for runs of rows of about BLOCK bytes of text."""
    for at, to, offsets, hashes, _ in tailed_blocks(batch, text, 0, fold):
        yield at, to, offsets, hashes


def tailed_blocks(batch: pa.RecordBatch, text: str, tail: int, fold: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray | None]]:
    """As word_blocks, with the hashes of the words' last `tail` bytes.

    Words are ``[^\\x20\\x09-\\x0D]+``; with fold, A-Z count as a-z. Null and empty texts have no words. Texts
    longer than a block are read whole, window by window.
    """
    if not batch.num_rows:
        return
    codes = _FOLDED if fold else _BYTE_CODES
    data, bounds = _bytes_of(batch.column(batch.schema.get_field_index(text)))
    at, rows = 0, batch.num_rows
    while at < rows:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + BLOCK, side="right")) - 1)
        part, own = data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        if len(part) > BLOCK:
            hashes, tails = _long_words(part, codes, tail)
            yield at, to, np.array([0, len(hashes)], dtype=np.int64), hashes, tails
        else:
            start, end = _word_spans(part, own)
            yield at, to, np.searchsorted(start, own), *_hash_spans(part, start, end, codes, tail)
        at = to


_STEPS = mix64(np.arange(101, 165, dtype=np.uint64))


def shingles(offsets: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, shingle hash), ordered by row and hash. A row with fewer words has one shingle of all its words."""
    counts = np.diff(offsets)
    rows = np.repeat(np.arange(len(counts)), counts)
    whole = np.flatnonzero((counts > 0) & (counts < size))
    with np.errstate(over="ignore"):
        n = max(0, len(hashes) - size + 1)
        code = np.zeros(n, dtype=np.uint64)
        for j in range(size):
            code += mix64(hashes[j : j + n] * _STEPS[j] + _STEPS[j + 32])
        fits = np.arange(n) + size <= offsets[rows[:n] + 1]
        code, owner = mix64(code)[fits], rows[:n][fits]
        if len(whole):
            short = np.zeros(len(whole), dtype=np.uint64)
            for j in range(size - 1):
                use = counts[whole] > j
                short[use] += mix64(hashes[offsets[whole[use]] + j] * _STEPS[j] + _STEPS[j + 32])
            code = np.concatenate([code, mix64(short ^ counts[whole].astype(np.uint64))])
            owner = np.concatenate([owner, whole])
    order = np.lexsort((code, owner))
    code, owner = code[order], owner[order]
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    return owner[keep], code[keep]


def per_batch(fn, schema: pa.Schema):
    """Wrap fn(batch) -> iterator of column dicts as a function for mapInArrow."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in fn(batch):
                yield record(columns, schema)

    return run


def record(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type) for f, c in ((f, columns[f.name]) for f in schema)],
        schema=schema,
    )


def single_threaded() -> None:
    """Spark already runs one task per core; tokenisers and BLAS start no threads of their own."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def add_columns(df: DataFrame, text: str, compute, fields: list[tuple[str, pa.DataType, str]], keep_text: bool = True) -> DataFrame:
    """df with columns that compute(batch) gives for each Arrow batch as [array per field]; fields: name, type, SQL type.

    Input columns of the same names are replaced. Without keep_text the text does not travel back.
    """
    text_batches(df.sparkSession)
    names = [n for n, _, _ in fields]
    source = df.drop(*names)
    kept = [n for n in source.columns if keep_text or n != text]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [batch.schema.get_field_index(n) for n in kept]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in at] + [pa.array(c, type=f[1]) for c, f in zip(compute(batch), fields, strict=True)],
                names=kept + names,
            )

    schema = source.select(*kept).schema
    for name, _, kind in fields:
        schema = schema.add(T.StructField(name, T.StructType.fromDDL(f"x {kind}")[0].dataType))
    return source.mapInArrow(run, schema)
