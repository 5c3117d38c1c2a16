"""Vector code compression: integer product codes; the nearest codebook entry is searched in a GNAT over the entries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import record, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Split points of a tree node.
DEGREE = 4
#: Integers up to here are exact in a double.
EXACT = 1 << 52
LARGEST = (1 << 63) - 1
#: Sums travel in pieces of so many bits, so that they fit a long whatever the components are.
PIECE_BITS = 40
#: Vectors of one batch that are compared at once.
CHUNK = 4096
#: Label totals up to so many rows are broadcast.
FEW_LABELS = 100_000


# --------------------------------------------------------------------------------------------------
# The tree


class Gnat:
    """Geometric near-neighbour access tree over the rows of an integer matrix.

    A node holds split points far from each other. Every other entry hangs below its nearest split point, and for each
    pair (split point i, child j) the node knows the least and the greatest squared distance from i to the entries of
    j. The matrix has doubles while all squared distances are exact in them, and Python integers otherwise.
    """

    def __init__(self, entries: np.ndarray, degree: int = DEGREE) -> None:
        self.entries, self.degree = entries, degree
        self.root = self._node(list(range(len(entries)))) if len(entries) else None

    def squares(self, rows: np.ndarray, entries: list[int]) -> np.ndarray:
        """Squared distances (row, entry)."""
        apart = rows[:, None, :] - self.entries[entries][None, :, :]
        return (apart * apart).sum(axis=2)

    def _node(self, members: list[int]) -> dict:
        splits = [members[0]]
        nearest = self.squares(self.entries[members], splits)[:, 0]
        while len(splits) < min(self.degree, len(members)):
            open_ = [i for i, m in enumerate(members) if m not in splits]
            far = max(open_, key=lambda i: (nearest[i], -i))
            splits.append(members[far])
            nearest = np.minimum(nearest, self.squares(self.entries[members], [members[far]])[:, 0])
        rest = [m for m in members if m not in splits]
        groups: list[list[int]] = [[] for _ in splits]
        if rest:
            for member, group in zip(rest, self.squares(self.entries[rest], splits).argmin(axis=1), strict=True):
                groups[group].append(member)
        ranges = [
            [(own.min(), own.max()) if len(own := self.squares(self.entries[g], [s])[:, 0]) else None for g in groups] for s in splits
        ]
        return {"splits": splits, "children": [self._node(g) if g else None for g in groups], "ranges": ranges}

    @staticmethod
    def _beyond(long: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where sqrt(long) > sqrt(a) + sqrt(b) for certain: integers are compared exactly, doubles with room for rounding."""
        if long.dtype == object or a.dtype == object or b.dtype == object:
            over = long - a - b
            return np.array([o > 0 and o * o > 4 * x * y for o, x, y in np.broadcast(over, a, b)], dtype=bool)
        room = 1e-12
        return np.sqrt(long) * (1 - room) > (np.sqrt(a) + np.sqrt(b)) * (1 + room)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest entry of each row; of equally near entries the lowest number.

        A child is left out only where its range proves that every entry in it is strictly farther than the best so
        far, so all equally near entries are compared, by their integer distances.
        """
        best = np.full(len(rows), -1, dtype=np.int64)
        reach = np.zeros(len(rows), dtype=rows.dtype)
        todo = [(self.root, np.arange(len(rows)))] if self.root and len(rows) else []
        while todo:
            node, at = todo.pop()
            apart = self.squares(rows[at], node["splits"])
            for j, entry in enumerate(node["splits"]):
                nearer = (best[at] < 0) | (apart[:, j] < reach[at]) | ((apart[:, j] == reach[at]) & (entry < best[at]))
                best[at[nearer]] = entry
                reach[at[nearer]] = apart[nearer, j]
            for j, child in enumerate(node["children"]):
                if child is None:
                    continue
                alive = np.ones(len(at), dtype=bool)
                for i in range(len(node["splits"])):
                    low, high = (np.full(len(at), x, dtype=rows.dtype) for x in node["ranges"][i][j])
                    alive &= ~self._beyond(apart[:, i], reach[at], high) & ~self._beyond(low, apart[:, i], reach[at])
                if alive.any():
                    todo.append((child, at[alive]))
        return best, reach


# --------------------------------------------------------------------------------------------------
# Vectors as integers


@dataclass
class Codebooks:
    """entries[part]: integers (entry, position within the part); width: components a part."""

    entries: list[np.ndarray]
    width: int
    exact: bool

    def trees(self) -> list[Gnat]:
        return [Gnat(e) for e in self.entries]

    def sha256(self) -> str:
        """Of all entries' decimal components by part, entry and position, joined by commas."""
        numbers = (str(int(x)) for part in self.entries for entry in part for x in entry)
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def integers(values: np.ndarray, exact: bool) -> np.ndarray:
    """floor(4096 x): as doubles, or as Python integers where doubles would not be exact."""
    if exact:
        return np.floor(values.astype(np.float64) * SCALE)
    out = np.empty(values.shape, dtype=object)
    for at, x in np.ndenumerate(values):
        top, bottom = float(x).as_integer_ratio()
        out[at] = top * SCALE // bottom
    return out


def finite_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows kept, their lengths, row of each component among the kept, components) of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    good = column.is_valid().to_numpy(zero_copy_only=False).copy()
    good[owner[~np.isfinite(values)]] = False
    use, number = good[owner], np.cumsum(good) - 1
    return np.flatnonzero(good), lengths[good], number[owner[use]], values[use]


def matrices(column: pa.Array, dims: int, exact: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows kept, integer matrix) in chunks; shorter vectors end in zeros."""
    kept, lengths, owner, values = finite_rows(column)
    place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    for at in range(0, len(kept), CHUNK):
        to = min(len(kept), at + CHUNK)
        first, last = np.searchsorted(owner, [at, to])
        dense = np.zeros((to - at, dims))
        dense[owner[first:last] - at, place[first:last]] = values[first:last]
        yield kept[at:to], integers(dense, exact)


# --------------------------------------------------------------------------------------------------
# Fitting

_FOUND = pa.schema([("id", pa.int64()), ("vector", pa.list_(pa.float64())), ("dims", pa.int64()), ("most", pa.float64())])


def _survey(entries: int):
    """Per partition: its first ids with their vectors, the greatest length and the largest component."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[int | None, list[float]] = {}
        dims, most, any_row = 0, 0.0, False
        order = lambda i: (i is None, i or 0)
        for batch in batches:
            kept, lengths, _, values = finite_rows(batch.column(1))
            if not len(kept):
                continue
            any_row = True
            dims = max(dims, int(lengths.max()))
            most = max(most, float(np.abs(values).max())) if len(values) else most
            ids = batch.column(0).take(pa.array(kept)).to_pylist()
            wanted = set(sorted(set(ids) | set(first), key=order)[:entries])
            starts = np.cumsum(lengths) - lengths
            for i, name in enumerate(ids):
                if name in wanted:
                    vector = values[starts[i] : starts[i] + lengths[i]].tolist()
                    first[name] = min(first.get(name, vector), vector)
            first = {name: first[name] for name in wanted}
        if any_row:
            rows = sorted(first.items(), key=lambda x: order(x[0]))
            yield record({"id": [r[0] for r in rows], "vector": [r[1] for r in rows], "dims": [dims] * len(rows), "most": [most] * len(rows)}, _FOUND)

    return run


def _sums(books: Codebooks, pieces: int):
    """Per partition: component sums and counts of every entry, as (key, value); see _next."""
    width, exact = books.width, books.exact
    parts, entries = len(books.entries), len(books.entries[0])
    schema = pa.schema([("key", pa.int64()), ("value", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = books.trees()
        total = np.zeros((parts, entries, width + 1), dtype=object)
        for batch in batches:
            for _, rows in matrices(batch.column(0), parts * width, exact):
                for p, tree in enumerate(trees):
                    own = rows[:, p * width : (p + 1) * width]
                    near, _ = tree.nearest(own)
                    for e in np.unique(near):
                        mine = own[near == e]
                        total[p, e, :width] += np.array([int(x) for x in mine.sum(axis=0)], dtype=object)
                        total[p, e, width] += len(mine)
        keys, values = [], []
        for at, number in enumerate(total.ravel().tolist()):
            for k in range(pieces):
                piece = number >> (PIECE_BITS * k)
                piece = piece if k == pieces - 1 else piece & ((1 << PIECE_BITS) - 1)
                if piece:
                    keys.append(at * pieces + k)
                    values.append(piece)
        yield record({"key": keys, "value": values}, schema)

    return run


def _next(books: Codebooks, vectors: DataFrame, pieces: int) -> Codebooks:
    """Entries replaced by the floor of their parts' mean; entries without parts stay."""
    rows = vectors.mapInArrow(_sums(books, pieces), "key long, value long").groupBy("key").agg(F.sum("value").alias("value"))
    parts, entries = len(books.entries), len(books.entries[0])
    total = np.zeros(parts * entries * (books.width + 1), dtype=object)
    # One number per component of an entry, and one count: no more rows than that come to the driver.
    for row in rows.collect():
        total[row.key // pieces] += row.value << (PIECE_BITS * (row.key % pieces))
    total = total.reshape(parts, entries, books.width + 1)
    out = []
    for p, old in enumerate(books.entries):
        new = old.copy()
        for e in range(entries):
            if total[p, e, books.width]:
                new[e] = np.array([s // total[p, e, books.width] for s in total[p, e, : books.width]], dtype=new.dtype)
        out.append(new)
    return Codebooks(out, books.width, books.exact)


def fit(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> Codebooks | None:
    """Codebooks of all vectors; None if no vector is usable.

    Vectors that are null or hold null or non-finite components take no part. Shorter vectors count as filled up with
    zeros to the longest one's length, made a multiple of ``parts``. A codebook starts as the parts of the vectors of
    the smallest distinct ids, null last; of vectors of one id the one that sorts first. Fewer ids give fewer entries.
    Only sums, one number per component of an entry, travel between rounds.
    """
    found = vectors.select(F.col(vec_id).cast("long").alias("id"), vector).mapInArrow(
        _survey(entries), "id long, vector array<double>, dims long, most double"
    )
    found = written(found, "codebook-start")
    dims, most = found.agg(F.max("dims"), F.max("most")).first()
    if dims is None:
        return None
    first = found.groupBy("id").agg(F.min("vector").alias("vector")).orderBy(F.asc_nulls_last("id")).limit(entries).collect()
    width = -(-dims // parts)
    bound = (int(most) + 2) * SCALE
    exact = width * (2 * bound) ** 2 < EXACT
    dense = np.zeros((len(first), parts * width))
    for i, row in enumerate(first):
        dense[i, : len(row.vector)] = row.vector
    start = integers(dense, exact)
    books = Codebooks([start[:, p * width : (p + 1) * width] for p in range(parts)], width, exact)
    pieces = -(-(bound.bit_length() + 64) // PIECE_BITS)
    for _ in range(rounds):
        books = _next(books, vectors.select(vector), pieces)
    return books


# --------------------------------------------------------------------------------------------------
# Codes


def encode(vectors: DataFrame, books: Codebooks | None, vector: str = "embedding") -> DataFrame:
    """The usable rows with ``code`` (two hex digits a part) and ``error`` (squared distances summed over the parts).

    Other columns stay, those named code or error are replaced. Repeated rows stay. An error beyond a long is the
    largest long. Without codebooks there are no usable rows, so the result is empty.
    """
    source = vectors.drop(*[c for c in ("code", "error") if c != vector])
    kept = [c for c in source.columns if c != vector]
    schema = T.StructType([source.schema[c] for c in kept]).add("code", "string").add("error", "long")
    asked = source.select(vector, *kept)
    if books is None:
        return asked.limit(0).select(*kept, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = books.trees()
        digits = np.array([f"{i:02x}" for i in range(len(books.entries[0]))])
        for batch in batches:
            for at, rows in matrices(batch.column(0), len(trees) * books.width, books.exact):
                codes, error = np.full(len(rows), "", dtype=object), np.zeros(len(rows), dtype=rows.dtype)
                for p, tree in enumerate(trees):
                    near, apart = tree.nearest(rows[:, p * books.width : (p + 1) * books.width])
                    codes, error = codes + digits[near].astype(object), error + apart
                places = pa.array(at)
                own = [batch.column(i + 1).take(places) for i in range(len(kept))]
                sized = [min(int(e), LARGEST) for e in error]
                yield pa.RecordBatch.from_arrays([*own, pa.array(codes, pa.string()), pa.array(sized, pa.int64())], names=[*kept, "code", "error"])

    return asked.mapInArrow(run, schema)


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """``label_error``: the errors of all rows of the same label, null being a label, no more than the largest long."""
    coded = coded.drop("label_error")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    totals = written(coded.groupBy(F.col(label).alias("_label")).agg(total.alias("label_error")), "label-errors")
    # Few labels are broadcast, which leaves a label with many rows where it is; else Spark splits it as it joins.
    totals = F.broadcast(totals) if totals.count() <= FEW_LABELS else totals
    return coded.join(totals, F.col(label).eqNullSafe(F.col("_label"))).drop("_label")


def query(embeddings: DataFrame) -> DataFrame:
    rows = embeddings.select("vec_id", "embedding", "label")
    books = fit(rows)
    coded = written(encode(rows, books), "vector-codes")
    sha = books.sha256() if books else hashlib.sha256(b"").hexdigest()
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def _oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    steps = [
        f"""kept AS MATERIALIZED (
    SELECT row_number() OVER () AS row_no, vec_id, label, embedding, len(embedding) // {parts} AS width FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"""comp AS MATERIALIZED (
    SELECT row_no, vec_id, (i - 1) // width AS part, (i - 1) % width AS pos, CAST(floor({SCALE} * CAST(embedding[i] AS DOUBLE)) AS HUGEINT) AS x
    FROM (SELECT row_no, vec_id, embedding, width, unnest(range(1, len(embedding) + 1)) AS i FROM kept)
)""",
        f"""book0 AS MATERIALIZED (
    SELECT part, entry, pos, x AS value FROM comp
    JOIN (SELECT row_no, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {entries}) USING (row_no)
)""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (
    SELECT row_no, part, min(d * {entries} + entry) AS best
    FROM (SELECT row_no, part, entry, sum((x - value) * (x - value)) AS d FROM comp JOIN book{r} USING (part, pos) GROUP BY ALL)
    GROUP BY ALL
)""")
        if r < rounds:
            steps.append(f"""book{r + 1} AS MATERIALIZED (
    SELECT part, entry, pos, CASE WHEN n IS NULL THEN value ELSE (s - ((s % n) + n) % n) // n END AS value
    FROM book{r} LEFT JOIN (
        SELECT part, best % {entries} AS entry, pos, CAST(sum(x) AS HUGEINT) AS s, CAST(count(*) AS HUGEINT) AS n
        FROM comp JOIN near{r} USING (row_no, part) GROUP BY ALL
    ) USING (part, entry, pos)
)""")
    last = f"near{rounds}"
    return f"""
WITH {", ".join(steps)},
coded AS (
    SELECT row_no, string_agg(printf('%02x', CAST(best % {entries} AS INT)), '' ORDER BY part) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error
    FROM {last} GROUP BY row_no
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(value AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM book{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (row_no)
"""


ORACLE = _oracle()
