import hashlib
import math
import random

import numpy as np
import pytest

from atticwork.llm import gnat_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code int, label_error string, note string"


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not rows:
        return [], ""
    dims = max(len(r[1]) for r in rows)
    width = -(-dims // parts)

    def whole(v):
        v = list(v) + [0.0] * (parts * width - len(v))
        out = []
        for x in v:
            top, bottom = float(x).as_integer_ratio()
            out.append(scale * top // bottom)
        return [tuple(out[p * width : (p + 1) * width]) for p in range(parts)]

    cut = [whole(r[1]) for r in rows]
    first = {}
    for i, r in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0, list(x[1][1]))):
        first.setdefault(r[0], i)
    seeds = list(first.values())[:entries]
    books = [[cut[i][p] for i in seeds] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, v: min(range(len(books[p])), key=lambda e: (far(v, books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for c in cut:
                mine.setdefault(near(p, c[p]), []).append(c[p])
            for e, members in mine.items():
                books[p][e] = tuple(sum(x) // len(members) for x in zip(*members, strict=True))
    out, sums = [], {}
    for r, c in zip(rows, cut, strict=True):
        codes = [near(p, c[p]) for p in range(parts)]
        error = min(sum(far(c[p], books[p][e]) for p, e in enumerate(codes)), 2**63 - 1)
        out.append((r[0], "".join(f"{e:02x}" for e in codes), error, r[2]))
        sums[r[2]] = sums.get(r[2], 0) + error
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, c, e, min(sums[lab], 2**63 - 1)) for i, c, e, lab in out), key=str), sha


def made(seed, n=120, dims=16):
    turn = random.Random(seed)
    rows = []
    for i in range(n):
        v = [turn.choice([turn.gauss(0, 1), 0.25, -0.25]) for _ in range(dims)]
        rows.append((i * 3 - 50, [float(np.float32(x)) for x in v], turn.choice([None, 1, 2]), 9, "x", "n"))
    rows += [rows[0], rows[40], (rows[2][0], rows[9][1], 1, 9, "x", "n"), (None, rows[3][1], 2, 9, "x", "n")]
    rows += [(1000, None, 1, 9, "x", "n"), (1001, [float("nan")] * dims, 1, 9, "x", "n"), (-2000, [None] + [1.0] * (dims - 1), 1, 9, "x", "n"), (-2001, [float("inf")], 1, 9, "x", "n")]
    turn.shuffle(rows)
    return rows


def found(spark, rows):
    out = gnat_codes.query(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    got = out.collect()
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str), {r.codebooks_sha256 for r in got}


@pytest.mark.parametrize("seed,dims", [(1, 16), (2, 8), (3, 19), (4, 3)])
def test_against_brute_force(spark, seed, dims):
    rows = made(seed, dims=dims)
    expected, sha = brute(rows)
    assert found(spark, rows) == (expected, {sha})


def test_lengths_that_differ_and_few_rows(spark):
    rows = [(i, [0.5] * i, None, 0, "", "") for i in range(9)]
    expected, sha = brute(rows)
    assert found(spark, rows) == (expected, {sha})
    rows = [(1, [], 1, 0, "", ""), (1, [], 1, 0, "", "")]
    assert found(spark, rows) == (brute(rows)[0], {hashlib.sha256(b"").hexdigest()})


def test_huge_components_are_exact(spark):
    turn = random.Random(8)
    rows = [(i, [float(np.float32(turn.choice([1e30, -1e30, 3e8, 1.0]) * turn.random())) for _ in range(16)], i % 2, 0, "", "") for i in range(40)]
    expected, sha = brute(rows)
    assert found(spark, rows) == (expected, {sha})


def test_empty_tables(spark):
    for rows in ([], [(1, None, 1, 0, "", ""), (2, [None], 1, 0, "", "")]):
        assert gnat_codes.query(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_other_columns_stay(spark):
    vectors = spark.createDataFrame(made(5), SCHEMA)
    coded = gnat_codes.encode(vectors, gnat_codes.fit(vectors))
    assert coded.columns == ["vec_id", "label", "label_error", "note", "code", "error"]
    assert gnat_codes.with_label_error(coded).columns == ["vec_id", "label", "note", "code", "error", "label_error"]


@pytest.mark.parametrize("kind", [np.float64, object])
def test_tree_finds_the_lowest_of_the_nearest(kind):
    turn = np.random.default_rng(3)
    for n, wide in ((1, 2), (5, 1), (16, 2), (200, 3), (64, 0)):
        entries = turn.integers(-6, 6, size=(n, wide)).astype(kind)
        rows = turn.integers(-8, 8, size=(150, wide)).astype(kind)
        apart = ((rows[:, None, :] - entries[None]) ** 2).sum(axis=2)
        best, reach = gnat_codes.Gnat(entries, degree=3).nearest(rows)
        assert (best == np.array([min(range(n), key=lambda e: (a[e], e)) for a in apart])).all()
        assert (reach == apart.min(axis=1)).all()


def test_tree_leaves_out_subtrees(monkeypatch):
    turn = np.random.default_rng(1)
    entries = np.concatenate([turn.integers(0, 50, size=(60, 4)) + 10_000 * k for k in range(4)]).astype(float)
    tree, compared = gnat_codes.Gnat(entries), []
    squares = tree.squares
    monkeypatch.setattr(tree, "squares", lambda rows, which: compared.append(len(rows) * len(which)) or squares(rows, which))
    tree.nearest(entries + 1)
    assert sum(compared) < 0.35 * len(entries) ** 2
