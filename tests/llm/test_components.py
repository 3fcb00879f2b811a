import random

import pytest

from radiolake.llm.components import connected, connected_by_leads


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {(x, find(x)) for x in root}


@pytest.mark.parametrize("how", [connected, connected_by_leads])
def test_equals_union_find(spark, how):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 140)] + [(i, i - 1) for i in range(240, 200, -1)]  # chains
    edges += [(rng.randint(300, 330), rng.randint(300, 330)) for _ in range(200)]  # a dense group
    edges += [(rng.randint(400, 480), rng.randint(400, 480)) for _ in range(40)]  # small ones
    edges += [(500, n) for n in range(501, 560)] + [(7, 7), (None, 3), (3, None)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {tuple(r) for r in how(df).collect()} == brute(edges)
    assert how(df.where("a < 0")).count() == 0
