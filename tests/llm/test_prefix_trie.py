import hashlib
import random
import zlib

import numpy as np
import pytest

from atticwork.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string"


def made(seed, n=160, hot=40):
    """Branching conversations with copies, holes among the multiples of 100, null turns, roles and texts."""
    turn = random.Random(seed)
    talks = []
    for i in range(n):
        length = turn.choice([1, 1, 2, 3, 4, 6, 9, 14])
        talks.append([(turn.choice(["user", None, ""]), turn.choice(["yes", "no", "é😀", "", None])) for _ in range(length)])
    for i in range(hot):
        talks[turn.randrange(n)] = talks[5]
    ids = turn.sample([i for i in range(0, 900) if i != 300], n - 4) + [100, -7, -100, 10**12 + 3]
    rows = []
    for c, talk in zip(dict.fromkeys(ids), talks):
        rows += [(c, None if t == 0 and c % 3 == 0 else t, r, x, 1, "k") for t, (r, x) in enumerate(talk)]
    rows.append((None, 0, "user", "nobody's", 1, "k"))
    turn.shuffle(rows)
    return rows


def brute(rows):
    talks = {}
    order = lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).digest())
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        talks.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    nodes = {}
    for c in talks:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole = tuple(talks.get(base, [])[:h] + talks[c][h:])
        for d in range(len(whole) + 1):
            nodes.setdefault(whole[:d], []).append((c, len(whole) == d))
    children, out = {}, []
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)

    totals = {}
    for p in sorted(nodes, key=len, reverse=True):
        kids = children.get(p, [])
        own = (len(nodes[p]) - 1) * len(p[-1][1]) if p else 0
        totals[p] = (1 if not kids else sum(totals[k][0] for k in kids), own + sum(totals[k][1] for k in kids))
    for p, members in nodes.items():
        above = min(m for m, _ in nodes[p[:-1]]) if p else None
        ends = ",".join(map(str, sorted(m for m, e in members if e)))
        out.append((min(m for m, _ in members), len(p), above, len(members), len(children.get(p, [])), *totals[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("band,shard", [(4096, 1 << 20), (4096, 12), (3, 1 << 20), (3, 12)])
def test_against_brute_force(spark, band, shard):
    rows = made(band + shard)
    found = prefix_trie.nodes(spark.createDataFrame(rows, SCHEMA), band, shard)
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


def test_long_conversations_over_many_bands(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BANDS", 4)
    long = [("user", f"t{i}") for i in range(90)]
    rows = [(c, t, r, x, 0, "") for c, n in ((1, 90), (2, 88), (3, 30), (205, 90)) for t, (r, x) in enumerate(long[:n])]
    found = prefix_trie.nodes(spark.createDataFrame(rows, SCHEMA), 2, 30)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


def test_empty_table_repeats_and_turnless(spark):
    assert prefix_trie.nodes(spark.createDataFrame([], SCHEMA)).collect() == []
    # 3 borrows some turns of the absent conversation 0 and has only one of its own.
    alone = [(c, 0, "user", "x", 0, "") for c in range(1, 40)] + [(1, 0, "user", "x", 0, "")] * 3
    found = prefix_trie.nodes(spark.createDataFrame(alone, SCHEMA), 4096, 8)
    assert sorted(map(tuple, found.collect()), key=str) == brute(alone)
    root = found.where("depth = 0").first()
    assert root.n_convs == 39 and root.parent_conv_id is None


def test_a_large_group_of_copies_is_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = [(100 * c, t, "user", f"same {t}", 0, "") for c in range(700) for t in range(3)]
    found = prefix_trie.nodes(spark.createDataFrame(rows, SCHEMA).repartition(6))
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


def test_double_array_holds_exactly_its_sequences():
    turn = np.random.default_rng(4)
    lists = [turn.integers(1, 12, size=turn.integers(0, 9)) for _ in range(300)] + [np.array([i]) for i in range(1, 200)]
    ids, offsets = np.concatenate(lists), np.r_[0, np.cumsum([len(x) for x in lists])]
    trie = prefix_trie.pack(ids, offsets)
    prefixes = {tuple(x[:d]) for x in lists for d in range(len(x) + 1)}
    assert len(trie.used) == len(prefixes)
    for x, end in zip(lists, trie.ends, strict=True):
        node = np.array([1])
        for c in x:
            node = trie.child(node, np.array([c]))
            assert node[0]
        assert node[0] == end
    for x in turn.integers(1, 200, size=(300, 3)):
        node, walked = np.array([1]), ()
        for c in x:
            node, walked = trie.child(node, np.array([c])), (*walked, c)
            assert bool(node[0]) == (walked in prefixes)
            if not node[0]:
                break
