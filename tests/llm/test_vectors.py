import random

import numpy as np
from pyspark.sql import functions as F

from atticwork.llm import cover_tree, cross_polytope

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def made(seed=1, n=260, dims=16):
    turn = np.random.default_rng(seed)
    base = turn.normal(size=(n, dims))
    for i in range(n // 2, n):
        base[i] = base[turn.integers(0, n // 4)] * turn.uniform(0.5, 2) + turn.normal(size=dims) * turn.choice([0.0, 0.02, 0.1, 0.3])
    rows = [(int(i * 7 - 50), [float(np.float32(v)) for v in x], int(turn.integers(0, 2)), "s") for i, x in enumerate(base)]
    bad = [(9001, None, 1, "s"), (9002, [0.0] * dims, 1, "s"), (9003, [float("nan")] + [1.0] * (dims - 1), 1, "s"), (9004, [None] + [1.0] * (dims - 1), 1, "s"),
           (9005, rows[0][1], None, "s"), (9006, rows[0][1][:-1], rows[0][2], "s"), (9007, [], 1, "s"), (9008, [float("inf")] * dims, 1, None), (9100, rows[3][1], rows[3][2], "s")]
    return rows + bad


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute_links(rows, cosine):
    n = len(rows)
    name, links = list(range(n)), [0] * n

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if a[2] is None or a[2] != b[2] or not usable(a[1]) or not usable(b[1]) or len(a[1]) != len(b[1]):
                continue
            x, y = np.array(a[1]), np.array(b[1])
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[i] += 1
                links[j] += 1
                name[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i in range(n):
        least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], links[i], least[root(i)], least[root(i)] == rows[i][0]) for i in range(n))


def test_cover_tree_against_brute_force(spark):
    rows = made()
    vectors = spark.createDataFrame(rows, SCHEMA)
    for block in (1024, 24):
        found = cover_tree.near_copies(vectors, 0.98, block_rows=block)
        assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
        assert sorted(map(tuple, found.collect())) == brute_links(rows, 0.98)


def test_tiny_and_huge_vectors_keep_their_links(spark):
    turn = np.random.default_rng(9)
    x = turn.normal(size=(60, 8))
    x[30:] = x[:30] + turn.normal(size=(30, 8)) * 0.05
    want = cover_tree.close_pairs(x, x, 0.98)
    assert want.sum() > 70
    odd = x * np.exp2(turn.choice([-1000, -560, 0, 560, 1000], 60))[:, None]
    assert (cover_tree.close_pairs(odd, odd, 0.98) == want).all()
    assert (cross_polytope.codes(odd, 2, 3) == cross_polytope.codes(x, 2, 3)).all()
    found = cover_tree.near_copies(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(odd)], "vec_id long, embedding array<double>, label int"), 0.98)
    assert {r.vec_id: r.n_links for r in found.collect()} == dict(enumerate((want.sum(1) - 1).tolist()))


def test_cover_tree_levels():
    turn = np.random.default_rng(5)
    x = turn.normal(size=(200, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = cover_tree.build_tree(x, 0.05)
    for (above, _, _), (below, parent, radius) in zip(tree.levels[:-1], tree.levels[1:], strict=True):
        assert set(above) <= set(below)
        assert len(parent) == len(below) and (radius >= 0).all()
    centre, _, radius = tree.levels[-1]
    assert (np.linalg.norm(x - x[centre[tree.leaf]], axis=1) <= radius[tree.leaf] + 1e-9).all()
    assert radius.max() <= 0.05


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cover_tree.query(empty).collect() == []
    assert cross_polytope.query(empty).collect() == []


def brute_nearest(rows, k):
    out = {}
    for q in rows:
        if q[0] % 100 or not usable(q[1]):
            continue
        near = {(float(np.sqrt(((np.array(r[1]) - np.array(q[1])) ** 2).sum())), r[0]) for r in rows if r[0] != q[0] and usable(r[1]) and len(r[1]) == len(q[1])}
        out[q[0]] = sorted(near)[:k]
    return out


def test_search_finds_nearly_all(spark):
    rows = made(3, 900, 32)
    found = cross_polytope.query(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute_nearest(rows, 10)
    hits = 0
    for q, near in want.items():
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(near) + 1))
        scores = [(r.score, r.vec_id) for r in own]
        assert scores == sorted(scores)
        true = {v: s for s, v in near}
        hits += sum(r.vec_id in true for r in own)
        assert all(abs(r.score - true[r.vec_id]) < 1e-12 for r in own if r.vec_id in true)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_few_rows_are_all_returned(spark):
    turn = random.Random(1)
    rows = [(i * 50, [turn.random() - 0.5 for _ in range(6)], 0, "s") for i in range(7)]
    found = cross_polytope.nearest(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows[:1], SCHEMA), tables=1, probes=1).collect()
    assert sorted(r.vec_id for r in found) == [50, 100, 150, 200, 250, 300]


def test_ties_go_to_the_smaller_id(spark, monkeypatch):
    monkeypatch.setattr(cross_polytope, "ROWS_PER_TASK", 8)
    rows = [(i, [1.0, 2.0, 3.0], 0, "s") for i in range(60)] + [(100, [1.0, 2.0, 3.5], 0, "s")]
    found = cross_polytope.query(spark.createDataFrame(rows, SCHEMA)).where(F.col("query_id") == 100).orderBy("rank").collect()
    assert [r.vec_id for r in found] == list(range(10))
