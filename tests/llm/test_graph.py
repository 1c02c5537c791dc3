from __future__ import annotations

import random

from opinara.llm.graph import connected_components


def brute(edges):
    root = {v: v for e in edges for v in e}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {v: find(v) for v in root}


def check(spark, edges):
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(found) == len({r.id for r in found})
    assert {r.id: r.component for r in found} == brute([e for e in edges if None not in e])


def test_paths_stars_and_random_graphs(spark):
    rng = random.Random(1)
    path = list(range(60))
    shuffled = path[:]
    rng.shuffle(shuffled)
    edges = list(zip(path, path[1:])) + [(100 + a, 100 + b) for a, b in zip(shuffled, shuffled[1:])]
    edges += [(300, k) for k in range(301, 360)] + [(k, 500) for k in range(400, 450)]
    edges += [(600 + rng.randrange(120), 600 + rng.randrange(120)) for _ in range(90)]
    check(spark, edges + edges[:10])


def test_no_edges_loops_and_nulls(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    odd = spark.createDataFrame([(1, 1), (None, 2), (3, None), (5, 4)], "a long, b long")
    assert {(r.id, r.component) for r in connected_components(odd).collect()} == {(4, 4), (5, 4)}
