from __future__ import annotations

import math

import numpy as np

from opinara.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, component string"


def brute(rows, threshold=0.98):
    root = {i: i for i, *_ in rows}
    degree = dict.fromkeys(root, 0)

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    def sound(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    good = [(i, np.array(v, np.float32).astype(float), label) for i, v, label, *_ in rows if sound(v, label)]
    for k, (i, v, a) in enumerate(good):
        for j, w, b in good[k + 1:]:
            if a == b and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= threshold:
                degree[i] += 1
                degree[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (degree[i], find(i), find(i) == i) for i in root}


def found(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def near_groups(seed, n=400):
    rng = np.random.default_rng(seed)
    rows, centres = [], rng.normal(size=(12, 16))
    for i in range(n):
        v = centres[rng.integers(12)] + rng.normal(size=16) * rng.choice([0.0, 0.02, 0.1, 0.2, 0.5])
        rows.append((int(i), (v * rng.choice([1.0, 3.0])).astype(np.float32).tolist(), int(rng.integers(3)), "x"))
    order = rng.permutation(n)
    return [(int(order[i]), *r[1:]) for i, r in enumerate(rows)]


def test_equals_all_pairs(spark):
    rows = near_groups(1)
    want = brute(rows)
    assert sum(d for d, *_ in want.values()) > 1000
    assert found(embeddings.near_vectors(spark.createDataFrame(rows, SCHEMA))) == want


def test_small_blocks_and_cells_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 5)
    monkeypatch.setattr(embeddings, "CELL", 300)
    rows = near_groups(2, 150)
    assert found(embeddings.near_vectors(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_tables_miss_almost_nothing():
    for n in (10, 10**5, 10**9):
        bits, tables = embeddings.tables_for(n, 0.98)
        agree = (1 - math.acos(0.98) / math.pi) ** bits
        assert (1 - agree) ** tables <= 1e-8


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0], 1, None), (2, [2.0, 0.0], 1, "c"), (3, [1.0, 0.0], 2, "c"), (4, [1.0, 0.0], None, "c"), (5, None, 1, "c"),
            (6, [], 1, "c"), (7, [0.0, 0.0], 1, "c"), (8, [None, 1.0], 1, "c"), (9, [float("nan"), 1.0], 1, "c"),
            (10, [float("inf"), 1.0], 1, "c"), (11, [1.0, 0.0, 0.0], 1, "c"), (12, [1.0, 0.0], 1, "c"), (13, [-1.0, -0.0], 1, "c"),
            (14, [-1.0, 0.0], 1, "c"), (15, [0.99, 0.2], 1, "c")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(embeddings.near_vectors(df)) == brute(rows)
    doubles = df.selectExpr("vec_id", "cast(embedding as array<double>) embedding", "label")
    assert found(embeddings.near_vectors(doubles)) == brute(rows)
    null = embeddings.near_vectors(spark.createDataFrame([(None, [1.0, 0.0], 1, "c")], SCHEMA)).collect()
    assert [(r.n_links, r.component_id, r.kept) for r in null] == [(0, None, False)]
    assert embeddings.near_vectors(df.where("false")).count() == 0
    twice = embeddings.near_vectors(df.where("vec_id = 1").union(df.where("vec_id = 1"))).collect()
    assert [(r.n_links, r.component_id, r.kept) for r in twice] == [(1, 1, True)] * 2


def test_vectors_of_extreme_size(spark):
    """Squares that would vanish or overflow neither make nor lose a link."""
    rows = [(1, [1e-200, 0.0, 0.0]), (2, [1.0, 0.3, 0.3]), (3, [1.0, -0.35, 0.3]), (4, [1e200, 1e200, 0.0]), (5, [1e200, 1.01e200, 0.0]),
            (6, [0.0, 0.0, 5e-324]), (7, [0.0, 0.0, 1e308])]
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label long")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(vectors).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 6)}
