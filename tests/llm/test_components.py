import random

from atticwork.llm.components import components


def reach(links):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in list(parent)}


def test_against_union_find(spark):
    turn = random.Random(4)
    links = [(turn.randrange(-60, 60) * 1_000_003, turn.randrange(-60, 60) * 1_000_003) for _ in range(70)]
    links += [(i, i + 1) for i in range(500, 560)] + [(900, i) for i in range(901, 960)] + [(7, 7)]
    found = {r[0]: r[1] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == reach(links)


def test_empty(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
