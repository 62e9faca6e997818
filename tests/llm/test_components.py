import random

from faultlens.llm.components import connected_components


def test_matches_union_find(spark):
    dice = random.Random(2)
    links = [(dice.randrange(300), dice.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, None), (7, 7)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        if b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = connected_components(spark.createDataFrame(links, "x LONG, y LONG"), "x", "y").collect()
    assert {r.node: r.component for r in got} == {i: root(i) for i in list(parent)}
    assert len(got) == len(parent)


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "x LONG, y LONG"), "x", "y").count() == 0
