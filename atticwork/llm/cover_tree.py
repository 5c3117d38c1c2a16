"""Embedding near-dedup: cover trees over blocks of vectors, traversed in pairs with covering-radius bounds."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import record, written
from .components import components

COSINE = 0.98
#: Vectors of one tree; a pair of trees is one task.
BLOCK_ROWS = 1024
#: Cells (Voronoi cells of pivots) of one label; a larger cell is cut into blocks by a hash of the id.
MOST_CELLS = 64
_SLACK = 1e-7


def usable(vector: Column) -> Column:
    """True for vectors that are not null or zero and have only finite components."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(x, lambda v: v != 0), F.lit(False))


@dataclass
class CoverTree:
    """Nested levels: every node of a level is a point whose descendants lie within radius; radii halve downwards.

    ``levels`` holds (centre, parent, radius) arrays, the last one with the leaf of each point in ``leaf``.
    """

    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    leaf: np.ndarray


def build_tree(unit: np.ndarray, finest: float) -> CoverTree:
    """A cover tree of unit vectors; nodes are split until they cover finest or less, or one point only."""
    n = len(unit)
    away = _distance(unit @ unit[0])
    levels = [(np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([away.max(initial=0.0)]))]
    node = np.zeros(n, np.int64)
    reach = max(float(away.max(initial=0.0)), finest)
    while levels[-1][2].max(initial=0.0) > finest:
        reach /= 2
        centres, parents, radii, below = [], [], [], np.empty(n, np.int64)
        order = np.argsort(node, kind="stable")
        bounds = np.searchsorted(node[order], np.arange(len(levels[-1][0]) + 1))
        for k, centre in enumerate(levels[-1][0]):
            rest = order[bounds[k] : bounds[k + 1]]
            if levels[-1][2][k] <= finest or len(rest) == 1:
                below[rest] = len(centres)
                centres.append(centre)
                parents.append(k)
                radii.append(levels[-1][2][k])
                continue
            while len(rest):
                d = _distance(unit[rest] @ unit[centre])
                near = d <= reach
                near |= rest == centre
                below[rest[near]] = len(centres)
                centres.append(centre)
                parents.append(k)
                radii.append(d[near].max())
                rest = rest[~near]
                if len(rest):
                    centre = rest[0]
        levels.append((np.array(centres), np.array(parents), np.array(radii)))
        node = below
    return CoverTree(levels, node)


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component to 0.5 to 1: squares neither vanish nor overflow,
    and all digits stay."""
    _, exponent = np.frexp(np.abs(x).max(1, initial=0.0))
    return np.ldexp(x, -exponent[:, None])


def close_pairs(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Matrix of the pairs of rows of a and b (double) with at least this cosine; exact, by dual traversal."""
    same = b is a
    a, b = scaled(a), scaled(b)
    length_a, length_b = (np.sqrt(np.einsum("ij,ij->i", v, v)) for v in (a, b))
    unit_a, unit_b = a / length_a[:, None], b / length_b[:, None]
    limit = math.sqrt(max(0.0, 2.0 - 2.0 * cosine))
    tree_a = build_tree(unit_a, limit / 4)
    tree_b = tree_a if same else build_tree(unit_b, limit / 4)
    alive = np.ones((1, 1), bool)
    for depth in range(max(len(tree_a.levels), len(tree_b.levels))):
        sides = []
        for tree in (tree_a, tree_b):
            if depth < len(tree.levels):
                sides.append(tree.levels[depth])
            else:  # the shallower tree waits at its leaves
                centre, _, radius = tree.levels[-1]
                sides.append((centre, np.arange(len(centre)), radius))
        (ca, pa_, ra), (cb, pb_, rb) = sides
        if depth:
            alive = alive[np.ix_(pa_, pb_)]
        rows, columns = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        part = np.ix_(rows, columns)
        d = _distance(unit_a[ca[rows]] @ unit_b[cb[columns]].T)
        alive[part] &= d <= ra[rows][:, None] + rb[columns][None, :] + limit + _SLACK
    pairs = alive[np.ix_(tree_a.leaf, tree_b.leaf)]
    rows, columns = np.flatnonzero(pairs.any(1)), np.flatnonzero(pairs.any(0))
    part = np.ix_(rows, columns)
    value = (a[rows] @ b[columns].T) / (length_a[rows][:, None] * length_b[columns][None, :])
    hit = pairs[part] & (value >= cosine)
    # At the edge the order of additions decides; there the sum is taken exactly.
    for i, j in zip(*np.nonzero(pairs[part] & (np.abs(value - cosine) < 1e-12)), strict=True):
        x, y = a[rows[i]], b[columns[j]]
        hit[i, j] = math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y)) >= cosine
    pairs[part] = hit
    return pairs


def _groups(links: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Least id that each row reaches over a symmetric link matrix."""
    out, seen = ids.copy(), np.zeros(len(ids), bool)
    for i in np.argsort(ids, kind="stable"):
        if seen[i]:
            continue
        front = np.zeros(len(ids), bool)
        front[i] = True
        while front.any():
            seen |= front
            out[front] = ids[i]
            front = links[front].any(0) & ~seen
    return out


_FOUND = pa.schema([("vec_id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _join_blocks(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        g, h = table.column("g")[0].as_py(), table.column("h")[0].as_py()
        ids, times, block = (table.column(c).to_numpy() for c in ("vec_id", "times", "block"))
        vectors = table.column("vector").combine_chunks()
        x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
        left, right = block == g, block == h
        counts, links = np.zeros(len(ids), np.int64), np.zeros((len(ids), len(ids)), bool)
        if left.any() and right.any():
            if g == h:
                links = close_pairs(x, x, cosine)
                links |= links.T
                np.fill_diagonal(links, False)
            else:
                links[np.ix_(left, right)] = close_pairs(x[left], x[right], cosine)
                links |= links.T
            counts = links.astype(np.float64) @ times.astype(np.float64)
        use = counts > 0
        roots = _groups(links[np.ix_(use, use)], ids[use])
        return pa.Table.from_batches([record({"vec_id": ids[use], "links": counts[use].astype(np.int64), "root": roots}, _FOUND)])

    return run


_ASSIGNED = "label int, vec_id long, times long, vector array<double>, cell int, dists array<double>"


def _assign(left: pa.Table, right: pa.Table) -> pa.Table:
    """Distances of each vector to the pivots of its label; without pivots there is one cell."""
    n = left.num_rows
    vectors = left.column("vector").combine_chunks()
    x = scaled(vectors.flatten().to_numpy(zero_copy_only=False).reshape(n, -1))
    x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    if right.num_rows:
        order = np.argsort(right.column("pivot_id").to_numpy(), kind="stable")
        p = right.column("pivot").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(right.num_rows, -1)[order]
        p = scaled(p)
        p = p / np.sqrt(np.einsum("ij,ij->i", p, p))[:, None]
        d = _distance(x @ p.T)
    else:
        d = np.zeros((n, 1))
    return pa.table(
        {
            "label": left.column("label"), "vec_id": left.column("vec_id"), "times": left.column("times"), "vector": vectors,
            "cell": pa.array(d.argmin(1).astype(np.int32)), "dists": pa.array(list(d), type=pa.list_(pa.float64())),
        }
    )


def near_copies(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors.

    Two rows link when their labels are equal and not null and their cosine, in double precision, is at least
    `cosine`. Vectors that are null, zero or hold null or non-finite components link with nothing, nor do vectors
    of different lengths. n_links counts other rows linked directly, component_id is the least id that can be
    reached, kept says that it is the row's own. Repeated ids are rows of their own. Other columns are not
    read; an empty table gives an empty table.

    Equal vectors of a label become one with a count. A label's vectors are dealt to the cells of hash-chosen
    pivots and cells to blocks of at most about block_rows. A vector goes to the blocks of another cell only if its
    distance to that cell's pivot is at most the cell's radius + r, and at most its own pivot's distance + 2 r,
    where r is the distance of the threshold; each pair of blocks is one task with two cover trees. Only
    link counts and a spanning set of links leave a task.
    """
    source = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).cast("int").alias("label")
    )
    good = source["label"].isNotNull() & source["vec_id"].isNotNull() & usable(source["vector"])
    key = [F.when(good, F.xxhash64(F.lit(s), "label", "vector")).alias(f"k{s}") for s in (1, 2)]
    rows = written(source.select("vec_id", *key), "vector-keys")
    reps = source.where(good).groupBy("label", F.size("vector").alias("dims"), "vector").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("times"))
    # Vectors of different lengths are kept apart as if they had different labels.
    reps = reps.withColumn("label", F.xxhash64("label", "dims")).withColumn("h", F.xxhash64("vec_id", F.lit(17)))
    reps = written(reps, "distinct-vectors")
    sizes = reps.groupBy("label").agg(F.count("*").alias("total"))
    sizes = written(sizes.withColumn("cells", F.least(F.lit(MOST_CELLS), F.ceil(F.col("total") / block_rows))), "label-sizes")
    sized = reps.join(sizes, "label")
    salt = F.pmod("h", F.ceil(F.col("total") / 8192))
    dealt = sized.select("label", salt.alias("salt"), "vec_id", "times", "vector")
    pivots = sized.where("cells > 1 AND pmod(h, total) < cells").select(
        "label", F.explode(F.sequence(F.lit(0), F.ceil(F.col("total") / 8192) - 1)).alias("salt"), F.col("vec_id").alias("pivot_id"), F.col("vector").alias("pivot")
    )
    pivots = written(pivots, "pivots")
    assigned = dealt.groupBy("label", "salt").cogroup(pivots.groupBy("label", "salt")).applyInArrow(_assign, _ASSIGNED.replace("label int", "label long"))
    assigned = written(assigned.where("vec_id IS NOT NULL"), "cells")
    cells = (
        assigned.groupBy("label", "cell")
        .agg(F.count("*").alias("held"), F.max(F.element_at("dists", F.col("cell") + 1)).alias("radius"))
        .withColumn("blocks", F.ceil(F.col("held") / block_rows).cast("int"))
    )
    cells = cells.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("cell", "blocks", "radius"))).alias("cells"))
    cells = written(cells, "cell-sizes")
    r = math.sqrt(max(0.0, 2.0 - 2.0 * cosine)) + _SLACK
    at = lambda c: F.element_at("dists", c["cell"] + 1)
    own = F.element_at("dists", F.col("cell") + 1)
    reach = F.filter("cells", lambda c: (c["cell"] == F.col("cell")) | ((at(c) <= c["radius"] + r) & (at(c) <= own + 2 * r)))
    placed = assigned.join(cells, "label").withColumn("mine", F.filter("cells", lambda c: c["cell"] == F.col("cell"))[0]["blocks"])
    placed = placed.withColumn("block", F.col("cell") * F.lit(1 << 32) + F.pmod(F.xxhash64("vec_id", F.lit(23)), F.col("mine")))
    placed = placed.select("label", "vec_id", "times", "vector", "block", F.explode(reach).alias("c"))
    placed = placed.select(
        "label", "vec_id", "times", "vector", "block",
        F.explode(F.sequence(F.lit(0), F.col("c.blocks") - 1)).alias("t"), F.col("c.cell").alias("other"),
    ).withColumn("there", F.col("other") * F.lit(1 << 32) + F.col("t"))
    paired = placed.select(
        "label", F.least("block", "there").alias("g"), F.greatest("block", "there").alias("h"), "block", "vec_id", "times", "vector"
    )
    found = paired.groupBy("label", "g", "h").applyInArrow(_join_blocks(cosine), "vec_id long, links long, root long")
    found = written(found, "vector-links")
    named = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    classes = (
        reps.join(sums, "vec_id", "left")
        .join(named, reps["vec_id"] == named["node"], "left")
        .select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", reps["vec_id"]).alias("component_id"))
    )
    classes = written(classes, "vector-classes")
    firsts = rows.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"))
    result = written(firsts.join(classes, firsts["rep"] == classes["vec_id"]).select("k1", "k2", "n_links", "component_id"), "vector-results")
    return rows.join(result, ["k1", "k2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(embeddings: DataFrame) -> DataFrame:
    return near_copies(embeddings.select("vec_id", "embedding", "label"))


ORACLE = """
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
), good AS (
  SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98
), reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM r JOIN pairs p ON r.b = p.a) SELECT * FROM r
), named AS (SELECT a, min(b) AS least FROM reach GROUP BY a), counted AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
FROM embeddings LEFT JOIN counted ON counted.a = vec_id LEFT JOIN named ON named.a = vec_id
"""
