"""Vector search: one query, many queries, persons by face, and embedding of text columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import vectors
from .ordered import parts_by_place
from .search import with_filters

def semantic_search(
    chunks: DataFrame,
    vec: list[float],
    top_k: int = 10,
    chunk_type: str | None = "",
    source: str | None = None,
    section: str | None = None,
    tie: str = "id",
) -> DataFrame:
    """The ``top_k`` chunks closest to a vector; filters first, then a bounded sort."""
    scored = with_filters(chunks, chunk_type, source, section).withColumn(
        "distance", vectors.cosine_distance(F.col("embedding"), vec)
    )
    return scored.orderBy(F.asc_nulls_last("distance"), tie).limit(top_k).drop("embedding")


# Query vectors up to this number go to every task; a longer table is dealt in blocks together with the corpus.
TABLE_QUERIES = 20_000
# Queries of one block, and parts of the corpus that a block meets one by one.
QUERY_BLOCK, CORPUS_PARTS = 4096, 64
# Corpus rows and queries that are compared at once.
_ROWS, _QUERIES = 2048, 1024


class _Nearest:
    """The ``k`` nearest rows so far of each query vector, by cosine distance, equal ones by id."""

    def __init__(self, names: list, queries: np.ndarray, k: int) -> None:
        self.names, self.k = names, k
        lengths = np.linalg.norm(queries, axis=1, keepdims=True)
        # A query without length has no direction: all rows are equally far from it.
        self._units = np.divide(queries, lengths, out=np.zeros_like(queries), where=lengths > 0)
        self._found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0))] * len(names)
        self._last = np.full(len(names), np.inf)

    def _within_reach(self, units: np.ndarray) -> np.ndarray:
        """Queries to which some of these rows may be nearer than their last one so far.

        By the rows' middle direction and the greatest angle from it: no row is nearer to a query than the middle's
        angle less that one. Rows that lie together are so left out for all queries far away."""
        middle = units.sum(axis=0)
        size = np.linalg.norm(middle)
        if size == 0 or np.isinf(self._last).all():
            return np.arange(len(self.names))
        middle = middle / size
        radius = np.arccos(np.clip(units @ middle, -1, 1)).max()
        angle = np.arccos(np.clip(self._units @ middle, -1, 1)) - radius - 1e-6
        least = 1 - np.cos(np.clip(angle, 0, np.pi))
        flat = ~self._units.any(axis=1)
        return np.flatnonzero((least <= self._last) | np.isinf(self._last) | flat)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Rows with a null, a NaN or without length have no distance: the first take no part, the last come last."""
        whole = ~np.isnan(rows).any(axis=1)
        ids, rows = ids[whole], rows[whole].astype("float64")
        for at in range(0, len(ids), _ROWS):
            part, own = rows[at : at + _ROWS], ids[at : at + _ROWS]
            size = np.linalg.norm(part, axis=1, keepdims=True)
            units = np.divide(part, size, out=np.zeros_like(part), where=size > 0)
            lengthless = (size == 0).any()
            wanted = np.arange(len(self.names)) if lengthless else self._within_reach(units)
            for q in range(0, len(wanted), _QUERIES):
                which = wanted[q : q + _QUERIES]
                distance = np.maximum(1 - self._units[which] @ units.T, 0.0)
                if lengthless:
                    distance = np.where(size.T > 0, distance, np.inf)
                for i, line in zip(which, distance, strict=True):
                    self._merge(i, own, line)

    def _merge(self, i: int, ids: np.ndarray, distance: np.ndarray) -> None:
        held_ids, held = self._found[i]
        if len(held) == self.k:
            near = np.flatnonzero(distance <= self._last[i])
            if not len(near):
                return
            ids, distance = ids[near], distance[near]
        elif len(ids) > self.k:
            near = np.flatnonzero(distance <= np.partition(distance, self.k - 1)[self.k - 1])
            ids, distance = ids[near], distance[near]
        ids, distance = (np.concatenate([held_ids, ids]), np.concatenate([held, distance])) if len(held) else (ids, distance)
        order = np.lexsort((ids, distance))[: self.k]
        self._found[i] = ids[order], distance[order]
        if len(order) == self.k:
            self._last[i] = distance[order[-1]]

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        found = [(name, i, d) for name, (ids, ds) in zip(self.names, self._found, strict=True) for i, d in zip(ids.tolist(), ds.tolist(), strict=True)]
        columns = zip(*found, strict=True) if found else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of the right length, and the vectors; null components are NaN."""
    fits = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False))
    values = column.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False)
    return fits, np.asarray(values, dtype="float64").reshape(len(fits), dims)


def _result(df: DataFrame, id_: str, query_type: T.DataType) -> tuple[pa.Schema, str]:
    kinds = [("query", query_type), (id_, df.schema[id_].dataType), ("distance", T.DoubleType())]
    return pa.schema([(n, to_arrow_type(k)) for n, k in kinds]), ", ".join(f"`{n}` {k.simpleString()}" for n, k in kinds)


def _one_scan(df: DataFrame, names: list, queries: np.ndarray, query_type: T.DataType, k: int, vector: str, id_: str) -> DataFrame:
    """Every task compares its rows with all queries and keeps its own ``k`` best of each."""
    arrow, sql = _result(df, id_, query_type)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = _Nearest(names, queries, k)
        for batch in batches:
            fits, rows = _matrix(batch.column(1), queries.shape[1])
            nearest.add(batch.column(0).take(pa.array(fits)).to_numpy(zero_copy_only=False), rows)
        yield nearest.batch(arrow)

    return df.select(id_, vector).mapInArrow(best, sql)


def _in_blocks(df: DataFrame, queries: DataFrame, count: int, dims: int, k: int, vector: str, id_: str) -> DataFrame:
    """Blocks of queries meet parts of the corpus. A task reads the queries of a block first, which are few, and then the
    rows of a part as a stream, so its memory does not depend on the size of either table."""
    blocks = -(-count // QUERY_BLOCK)
    query_type, id_type = queries.schema["query"].dataType, df.schema[id_].dataType
    arrow, sql = _result(df, id_, query_type)
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")
    part = F.pmod(F.xxhash64(id_), F.lit(CORPUS_PARTS)).cast("int")
    asked = queries.select(block.alias("_block"), everywhere(CORPUS_PARTS).alias("_part"), F.lit(0).alias("_row"), "query",
                           F.lit(None).cast(id_type).alias("_id"), F.col("vector").cast("array<double>").alias("_vector"))
    rows = df.select(everywhere(blocks).alias("_block"), part.alias("_part"), F.lit(1).alias("_row"), F.lit(None).cast(query_type).alias("query"),
                     F.col(id_).alias("_id"), F.col(vector).cast("array<double>").alias("_vector"))
    dealt = asked.unionByName(rows).repartition("_block", "_part").sortWithinPartitions("_block", "_part", "_row")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, vectors, nearest = None, [], [], None
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), len(key)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if a == z:
                    continue
                if tuple(key[a, :2]) != now:
                    if nearest is not None:
                        yield nearest.batch(arrow)
                    now, names, vectors, nearest = tuple(key[a, :2]), [], [], None
                fits, own = _matrix(batch.column(5).slice(a, z - a), dims)
                if key[a, 2] == 0:
                    names += batch.column(3).slice(a, z - a).take(pa.array(fits)).to_pylist()
                    vectors.append(own)
                elif names:
                    nearest = nearest or _Nearest(names, np.concatenate(vectors), k)
                    nearest.add(batch.column(4).slice(a, z - a).take(pa.array(fits)).to_numpy(zero_copy_only=False), own)
        if nearest is not None:
            yield nearest.batch(arrow)

    return dealt.mapInArrow(best, sql)


def nearest_to_each(
    df: DataFrame, queries: list[tuple[str, list[float]]] | DataFrame, k: int, vector: str = "embedding", id_: str = "id"
) -> DataFrame:
    """The ``k`` nearest rows for each of many query vectors, exactly, with one scan of the rows.

    ``queries`` are a list or a table ``(query, vector)``. Every task keeps its own ``k`` best per query, so what is
    shuffled is tasks × queries × k rows and no pair of query and row is ever emitted; rows that lie together are
    left out for the queries that are too far from all of them. Up to TABLE_QUERIES queries go to every task. To know
    that, the first of a table are fetched when the frame is built; a longer table is dealt in blocks with the corpus.

    Queries and rows take part if they have the length of the first query and no null or NaN. Rows without a
    direction come last, without a distance. The names of the queries are unique.
    """
    if isinstance(queries, DataFrame):
        table = queries.select("query", "vector").filter(F.col("vector").isNotNull() & (F.size("vector") > 0))
        first = table.limit(TABLE_QUERIES + 1).collect()
        if not first:
            raise ValueError("no queries")
        dims, query_type = len(first[0].vector), table.schema["query"].dataType
        if len(first) > TABLE_QUERIES:
            fits = table.filter((F.size("vector") == dims) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x.cast("double"))))
            partial = _in_blocks(df, fits, fits.count(), dims, k, vector, id_)
        else:
            usable = [r for r in first if len(r.vector) == dims and all(x is not None and x == x for x in r.vector)]
            matrix = np.asarray([r.vector for r in usable], dtype="float64").reshape(-1, dims)
            partial = _one_scan(df, [r.query for r in usable], matrix, query_type, k, vector, id_)
    elif not queries:
        raise ValueError("no queries")
    else:
        matrix = np.asarray([vec for _, vec in queries], dtype="float64")
        partial = _one_scan(df, [name for name, _ in queries], matrix, T.StringType(), k, vector, id_)
    w = W.partitionBy("query").orderBy("distance", id_)
    best = partial.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    # A vector without length has no distance.
    return best.withColumn("distance", F.when(F.col("distance") != float("inf"), F.col("distance")))


def retrieve_context(hits: DataFrame, rank: str = "rank", query: str = "query") -> DataFrame:
    """One text per query from its ranked chunks: ``[source] — section`` headers, separated by a rule.

    ``rank`` numbers the chunks of a query from 1, so they are put together without being ordered again."""
    head = F.concat(
        F.lit("["), F.col("source"), F.lit("]"),
        F.when(F.col("section") != "", F.concat(F.lit(" — "), F.col("section"))).otherwise(""),
    )
    block = F.concat(head, F.lit("\n"), F.col("content"))
    parts = parts_by_place(hits, [query], rank, block, "blocks")
    return parts.select(query, "part", F.array_join("blocks", "\n\n---\n\n").alias("context"))


def nearest_persons(
    vectors_: DataFrame, faces: DataFrame, persons: DataFrame, vec: list[float], k: int = 20
) -> DataFrame:
    """Named persons by their closest face.

    ``vectors_(face_id, embedding)``, ``faces(face_id, person_id)``, ``persons(person_id, name)``. Faces
    are reduced to one row per person before the names are joined.
    """
    scored = vectors_.select("face_id", vectors.cosine_distance(F.col("embedding"), vec).alias("d"))
    per_person = (
        scored.join(faces.filter("person_id is not null"), "face_id")
        .groupBy("person_id")
        .agg(F.min("d").alias("distance"), F.count(F.lit(1)).alias("face_count"))
    )
    named = persons.filter("name is not null and name <> ''").select("person_id", "name")
    return (
        per_person.join(named, "person_id")
        .orderBy(F.asc_nulls_last("distance"), "person_id")
        .limit(k)
        .withColumn("distance", F.round("distance", 4))
    )


def split_matches(hits: DataFrame, cut: float = 0.5, tie: str = "person_id") -> DataFrame:
    """Mark hits ``strong`` from similarity ``cut`` up. If there is none, the best hit counts as strong.

    ``hits`` is a top-k result, so one task ranks at most k rows."""
    order = W.orderBy(F.asc_nulls_last("distance"), tie)
    strong = F.coalesce((1 - F.col("distance")) >= cut, F.lit(False))
    return hits.withColumn("strong", strong | (F.row_number().over(order) == 1))


def embed(df: DataFrame, text: str, fn: Callable[[list[str]], list[list[float]]], retries: int = 3) -> DataFrame:
    """Add ``embedding`` from a batch function. A batch that fails or returns NaN is redone row by row;
    rows that still fail get null and are dropped."""

    def usable(v) -> bool:
        return v is not None and not np.isnan(np.asarray(v, dtype="float64")).any()

    def one(value: str):
        for _ in range(retries):
            try:
                vec = fn([value])[0]
            except Exception:
                continue
            if usable(vec):
                return vec
        return None

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            values = batch.fillna("").tolist()
            try:
                out = list(fn(values))
                if not all(usable(v) for v in out):
                    raise ValueError("unusable vector")
            except Exception:
                out = [one(v) for v in values]
            yield pd.Series(out, index=batch.index)

    return df.withColumn("embedding", run(F.col(text))).filter("embedding is not null")


def letter_vector(text: Column, alphabet: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """Letter counts as a vector: a deterministic stand-in where no embedding model is at hand."""
    low = F.lower(text)
    return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("float") for c in alphabet])
