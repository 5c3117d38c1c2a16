"""Approximate nearest neighbours: cross-polytope hashing with fast pseudo-rotations and multiprobe tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import per_batch, record, written
from .cover_tree import scaled, usable

TABLES = 4
PROBES = 36
NEIGHBOURS = 10
#: Rows and queries of one bucket that meet in one task; larger buckets are cut by hashes of the ids.
ROWS_PER_TASK, QUERIES_PER_TASK = 16_384, 2_048


def pseudo_rotation(unit: np.ndarray, table: int) -> np.ndarray:
    """Three rounds of seeded sign flips and fast Hadamard transforms; the dimension is padded to a power of two."""
    n, dims = unit.shape
    wide = 1 << max(0, dims - 1).bit_length()
    out = np.zeros((n, wide))
    out[:, :dims] = unit
    signs = np.random.default_rng([table, wide])
    for _ in range(3):
        out = out * signs.choice([-1.0, 1.0], wide)
        half = 1
        while half < wide:
            pairs = out.reshape(n, wide // (2 * half), 2, half)
            out = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(n, wide)
            half *= 2
        out = out / np.sqrt(wide)
    return out


def codes(vectors: np.ndarray, tables: int, probes: int) -> np.ndarray:
    """(row, table, probe): signed axes by falling coordinate, the nearest first; axis i and its negative are i and i + d."""
    vectors = scaled(vectors)
    unit = vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
    out = []
    for t in range(tables):
        y = pseudo_rotation(unit, t)
        both = np.concatenate([y, -y], axis=1)
        if probes == 1:
            out.append(both.argmax(1)[:, None])
        else:
            out.append(np.argsort(-both, axis=1, kind="stable")[:, :probes])
    return np.stack(out, axis=1)


def _hashed(rows: DataFrame, tables: int, probes: int) -> DataFrame:
    """Rows (vec_id, vector) with one row per table and probed code."""
    schema = pa.schema([("vec_id", pa.int64()), ("vector", pa.list_(pa.float64())), ("dims", pa.int32()), ("keys", pa.list_(pa.int32()))])

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        vectors = batch.column(1)
        dims = np.diff(vectors.offsets.to_numpy())
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            for chunk in np.array_split(at, -(-len(at) // 2048)):
                part = vectors.take(pa.array(chunk))
                x = part.flatten().to_numpy(zero_copy_only=False).reshape(len(chunk), d)
                found = codes(x, tables, probes)
                keys = found + np.arange(tables)[None, :, None] * (1 << 20)
                yield {
                    "vec_id": batch.column(0).take(pa.array(chunk)), "vector": part, "dims": np.full(len(chunk), d, np.int32),
                    "keys": pa.array(list(keys.reshape(len(chunk), -1).astype(np.int32)), type=pa.list_(pa.int32())),
                }

    out = rows.mapInArrow(per_batch(run, schema), "vec_id long, vector array<double>, dims int, keys array<int>")
    return out.select("vec_id", "vector", "dims", F.explode("keys").alias("key"))


_NEAR = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _nearest(k: int):
    """For the rows and queries of one task: each query's k nearest rows, with all ties of the k-th."""

    def run(table: pa.Table) -> pa.Table:
        ids, is_query = table.column("vec_id").to_numpy(), table.column("is_query").to_numpy(zero_copy_only=False)
        x = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        rows, row_ids, queries, query_ids = x[~is_query], ids[~is_query], x[is_query], ids[is_query]
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        squares = np.einsum("ij,ij->i", rows, rows)
        for at in range(0, len(queries) if len(rows) else 0, 256):
            q = queries[at : at + 256]
            # Squared distances without the query's own part; only a first sieve, with room for rounding.
            rough = squares[None, :] - 2 * (q @ rows.T)
            for i, near in enumerate(rough):
                own = row_ids == query_ids[at + i]
                near = np.where(own, np.inf, near)
                kth = np.partition(near, k - 1)[k - 1] if len(near) > k else np.inf
                room = 1e-9 * (1 + squares.max() + q[i] @ q[i])
                use = np.flatnonzero((near <= kth + room) & ~own)
                score = np.sqrt(((rows[use] - q[i]) ** 2).sum(1))
                order = np.lexsort((row_ids[use], score))[:k]
                out["query_id"].append(np.full(len(order), query_ids[at + i]))
                out["vec_id"].append(row_ids[use][order])
                out["score"].append(score[order])
        return pa.Table.from_batches([record({n: np.concatenate(v) if v else np.zeros(0) for n, v in out.items()}, _NEAR)])

    return run


def _search(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """k nearest rows per query and bucket, for tables (vec_id, vector, dims, key)."""
    sizes = rows.groupBy("dims", "key").agg(F.count("*").alias("n"), F.lit(0).alias("m")).unionByName(
        queries.groupBy("dims", "key").agg(F.lit(0).alias("n"), F.count("*").alias("m"))
    )
    sizes = sizes.groupBy("dims", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).where("n > 0 AND m > 0")
    sizes = written(
        sizes.select("dims", "key", F.ceil(F.col("n") / ROWS_PER_TASK).cast("int").alias("rs"), F.ceil(F.col("m") / QUERIES_PER_TASK).cast("int").alias("qs")),
        "bucket-sizes",
    )
    cut = lambda n, s: F.pmod(F.xxhash64("vec_id", F.lit(s)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = rows.join(sizes, ["dims", "key"]).select("dims", "key", cut("rs", 31).alias("r"), every("qs").alias("q"), "vec_id", "vector", F.lit(False).alias("is_query"))
    asked = queries.join(sizes, ["dims", "key"]).select("dims", "key", every("rs").alias("r"), cut("qs", 37).alias("q"), "vec_id", "vector", F.lit(True).alias("is_query"))
    return held.unionByName(asked).groupBy("dims", "key", "r", "q").applyInArrow(_nearest(k), "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, tables: int = TABLES, probes: int = PROBES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows found, by Euclidean distance in double precision.

    Every row is in the bucket of its nearest signed axis in each table; a query looks into the `probes` nearest
    axes of each table, and candidates are ranked by the exact distance of the original vectors, ties to the smaller
    id. A query for which fewer than k rows are found is compared with all rows, in blocks. A query's own id is
    no candidate. Vectors that are null, zero or hold null or non-finite components take no part; vectors of
    different lengths are not compared. Rows with one id and one vector count once. Null ids take no part.
    Empty tables give an empty result; other columns are not read.
    """

    def clean(df: DataFrame) -> DataFrame:
        got = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
        return got.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))

    rows = written(_hashed(clean(vectors), tables, 1), "buckets")
    asked = written(_hashed(clean(queries), tables, probes), "probes")
    found = written(_search(rows, asked, k).distinct(), "nearest")
    enough = found.groupBy("query_id").agg(F.countDistinct("vec_id").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"))
    short = written(asked.select("vec_id", "vector", "dims").distinct().join(enough, "vec_id", "left_anti").withColumn("key", F.lit(-1)), "short")
    if not short.isEmpty():
        whole = rows.where(F.floor(F.col("key") / (1 << 20)) == 0).withColumn("key", F.lit(-1))
        found = written(found.unionByName(_search(whole, short, k)).distinct(), "nearest-all")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(embeddings: DataFrame) -> DataFrame:
    rows = embeddings.select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 100 = 0"))
