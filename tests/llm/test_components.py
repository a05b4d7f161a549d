import random

from tessera.llm.components import components


def test_random_graphs_and_a_long_chain(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(100, 180)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    want = {x: find(x) for x in list(parent)}
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0
