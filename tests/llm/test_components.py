"""Connected components against union-find."""

import random

from quaystack.llm.components import connected_components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent if find(x) != x}


def check(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(df).collect()}
    assert got == brute(edges)


def test_paths_stars_and_random_graphs(spark):
    rng = random.Random(1)
    path = [(i, i + 1) for i in range(60)]
    rng.shuffle(path)
    star = [(1000, 1001 + i) for i in range(80)]
    rand = [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(120)]
    check(spark, path + star + rand + [(5, 5), (-7, 3), (-7, 3)])


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
