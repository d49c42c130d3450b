import random

from larkspur.llm.components import components


def test_components(spark):
    r = random.Random(0)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(90)] + [(5, 5), (None, 3), (2, 1)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    found = {row.node: row.root for row in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert found == {n: root(n) for n in parent}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "x long, y long")).collect() == []
