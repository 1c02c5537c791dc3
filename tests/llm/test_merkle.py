from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from opinara.llm import merkle, order
from opinara.llm.merkle import folded, manifest, proof_digest

from .cases import SCHEMA, odd_docs


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row) -> str:
    return sha(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in merkle.FIELDS))


def climb(nodes):
    """What remains of a list of digests, and each one's siblings (before, after) on the way."""
    paths, where, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        runs = [level[i:i + 16] for i in range(0, len(level), 16)]
        for i, at in enumerate(where):
            run = runs[at // 16]
            paths[i].append(("".join(run[:at % 16]), "".join(run[at % 16 + 1:])))
        where, level = [at // 16 for at in where], [sha(*run) for run in runs]
    return level[0], paths


def brute(rows):
    sources = defaultdict(list)
    for r in rows:
        sources[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    done = {s: climb([x[2] for x in sorted(sources[s])]) for s in names}
    root, top = climb([done[s][0] for s in names])
    out = []
    for s, above in zip(names, top):
        for (known, doc_id, leaf), path in zip(sorted(sources[s]), done[s][1]):
            proof = sha(*(a + b for a, b in path + above))
            out.append((doc_id if known else None, leaf, done[s][0], root, proof, root, True))
    return sorted(out, key=repr)


def found(docs):
    got = manifest(docs).select("doc_id", "leaf", "subroot", "root", proof_digest().alias("p"), folded("claimed").alias("f"))
    return sorted(((*r, r["f"] == r["root"]) for r in got.collect()), key=repr)


def corpus(spark, sizes):
    rows = [(i * 7 % 1009 if i % 50 else None, f"text {i % 90}", "en", s, i, "x") for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA.format(extra="level")).repartition(5)


def test_equals_brute_force(spark):
    docs = corpus(spark, {"b": 700, "a": 16, "c": 17, None: 257, "lone": 1, "é": 2, "": 3, **{f"s{i}": i % 4 + 1 for i in range(30)}})
    assert found(docs) == brute(docs.collect())


def test_few_sources_and_a_lone_leaf(spark):
    for sizes in ({"a": 1}, {"a": 4097}, {"a": 1, None: 1}):
        docs = corpus(spark, sizes)
        assert found(docs) == brute(docs.collect())


def test_odd_rows(spark):
    docs = odd_docs(spark, "leaf")
    assert found(docs) == brute(docs.collect())
    assert found(odd_docs(spark, "tree").limit(0)) == []


def test_another_text_leads_elsewhere(spark):
    docs = corpus(spark, {"a": 100, "b": 5})
    got = manifest(docs, F.when(F.col("doc_id") % 3 == 0, F.upper("text")).otherwise(F.col("text")))
    rows = got.select("doc_id", (folded("claimed") == F.col("root")).alias("same"), (folded("leaf") == F.col("root")).alias("sound")).collect()
    assert all(r.sound for r in rows)
    assert all(r.same == (r.doc_id is None or r.doc_id % 3 != 0) for r in rows)


def test_places_of_a_hot_key_over_partitions(spark):
    rows = [("hot" if i % 3 else f"k{i % 11}", i // 2 * 37 % 400, i) for i in range(900)]
    got = order.numbered(spark.createDataFrame(rows, "key string, v long, row long"), "key", [F.col("v"), F.col("row")], "t")
    want = {}
    for key in {r[0] for r in rows}:
        for pos, r in enumerate(sorted(r for r in rows if r[0] == key)):
            want[r[2]] = pos
    assert {r.row: r.pos for r in got.collect()} == want


def test_values_of_hot_keys_and_others(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)], "k string, i long")
    values = spark.createDataFrame([("hot", 1), *((f"k{i}", i) for i in range(0, 300, 6))], "k string, v long")
    got = order.join_values(rows, values, ["k"], "t")
    assert sorted((r.i, r.v) for r in got.collect()) == sorted((i, 1 if i % 3 else i) for i in range(300) if i % 3 or i % 6 == 0)
