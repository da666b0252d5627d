import random

from seriesmill.llm.components import components


def test_against_union_find(spark):
    draw = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(200, x) for x in range(201, 260)] + [(draw.randint(300, 400), draw.randint(300, 400)) for _ in range(60)]
    edges += [(500, 500), (None, 3), edges[0]]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in list(root)}


def test_empty(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
