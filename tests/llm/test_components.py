import random

from courtfold.llm.components import connected_components


def by_hand(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in list(parent)}


def test_components_match_union_find(spark):
    rng = random.Random(2)
    random_edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)]
    star = [(10_000, 9_000 + i) for i in range(60)]  # the hub has the largest id
    chain = [(20_000 + i, 20_001 + i) for i in range(150)]
    rng.shuffle(chain)
    for edges in (random_edges, star, chain, [(1, None), (None, 2), (3, 3), (4, 5), (5, 4), (4, 5)], []):
        frame = spark.createDataFrame(edges, "u long, v long")
        assert {tuple(r) for r in connected_components(frame).collect()} == by_hand(edges)
