"""Search recall, both candidate paths of passages, and results under heavy skew."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import Window, functions as F

from opinara import adapters as A
from opinara.operators import passages as G
from opinara.operators import readings as R
from opinara.operators import search as S
from opinara.operators.mentions import AliasSet
from opinara.sources.sinks import first_wins

SF = "/root/testdata/sf0.01"


def test_search_against_numpy(spark):
    vectors = A.vectors(spark, SF)
    data = vectors.select("external_id", "subject", "embedding").collect()
    m = np.array([r.embedding for r in data], dtype=np.float64)
    unit = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)
    q = m[7]
    sims = unit @ (q / (np.linalg.norm(q) + 1e-9))
    want = [data[i].external_id for i in sorted(range(len(data)), key=lambda i: (-sims[i], data[i].external_id))]
    got = [r.external_id for r in S.semantic_search(vectors, list(map(float, q)), 30).collect()]
    assert got == want[:30]
    mine = [e for e in want if next(r for r in data if r.external_id == e).subject == "3"]
    assert [r.external_id for r in S.semantic_search(vectors, list(map(float, q)), 5, "3").collect()] == mine[:5]
    by_expr = vectors.withColumn("s", S.cosine_expr("embedding", F.array(*[F.lit(float(x)) for x in q]))).orderBy(F.desc("s"), "external_id").limit(30)
    assert [r.external_id for r in by_expr.collect()] == want[:30]


def test_inverted_file_recall_and_layout(spark, tmp_path):
    vectors = A.vectors(spark, SF)
    centres = S.train_cells(vectors, 16)
    S.write_index(vectors, centres, f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    assert index.count() == vectors.count()
    hits = total = 0
    for r in vectors.filter("external_id % 100 = 0").collect():
        q = list(map(float, r.embedding))
        exact = {x.external_id for x in S.semantic_search(vectors, q, 10).collect()}
        assert {x.external_id for x in S.match_items(index, centres, q, 10, probes=16).collect()} == exact
        hits += len(exact & {x.external_id for x in S.match_items(index, centres, q, 10, probes=8).collect()})
        total += 10
    assert hits / total > 0.6
    plan = S.match_items(index, centres, q, 10, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan or "cell" in plan.split("PartitionFilters:")[1].split("]")[0]


@pytest.mark.parametrize("copies", [1, 3])
def test_batch_search_equals_single_searches(spark, tmp_path, copies):
    vectors = A.vectors(spark, SF)
    centres = S.train_cells(vectors, 16, sample=200)
    path = f"{tmp_path}/index"
    S.write_index(vectors.filter("external_id % 3 > 0"), centres, path, copies)
    S.add_to_index(vectors.filter("external_id % 3 = 0"), centres, path, copies)
    index = spark.read.parquet(path)
    assert index.count() == vectors.count() * copies
    queries = vectors.filter("external_id % 100 = 0").select(F.col("external_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    queries = queries.unionByName(queries.limit(1).select(F.lit(-1).cast("bigint").alias("query_id"), F.lit(None).cast("array<float>").alias("query_vector")))
    got = {}
    for r in S.match_many(index, centres, queries, 10, probes=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.external_id)
    asked = queries.filter("query_id in (0, 200, 400)").collect()
    for r in asked:
        assert got[r.query_id] == [x.external_id for x in S.match_items(index, centres, list(map(float, r.query_vector)), 10, probes=4).collect()]
    assert -1 not in got and len(got) == queries.count() - 1
    every = S.match_many(index, centres, queries, 10, probes=16).filter("query_id = 200").orderBy("rank").collect()
    query = next(list(map(float, r.query_vector)) for r in asked if r.query_id == 200)
    assert [r.external_id for r in every] == [r.external_id for r in S.semantic_search(vectors, query, 10).collect()]


@pytest.mark.parametrize("copies,probes", [(1, 8), (3, 8), (3, 2)])
def test_batch_search_meets_in_blocks_and_equals_all_pairs(spark, tmp_path, monkeypatch, copies, probes):
    """Many small blocks, copied and near vectors, repeated and null ids, NaN and zero vectors: the rows of all pairs."""
    for name, value in (("ITEM_BLOCK", 32), ("QUERY_BLOCK", 4), ("QUERIES_AT_ONCE", 3)):
        monkeypatch.setattr(S, name, value, raising=False)
    m = np.random.default_rng(3).normal(size=(400, 6)).round(1).astype(np.float32)
    m[100:180] = m[100]
    m[180:200] = m[100] * np.float32(2)
    m[200], m[201], m[202, 0] = 0, m[101], np.nan
    data = [(None if i in (5, 120) else i, [float(x) for x in v]) for i, v in enumerate(m)]
    data += [data[100], data[150], data[300], data[300], (400, None)]
    vectors = spark.createDataFrame(data, "external_id long, embedding array<float>")
    asked = [(i, data[i][1]) for i in (0, 7, 100, 101, 180, 200, 300, 300, 399)] + [(0, data[8][1]), (500, None), (None, data[9][1])]
    queries = spark.createDataFrame(asked, "query_id long, query_vector array<float>")
    centres = np.random.default_rng(4).normal(size=(8, 6)).tolist()
    S.write_index(vectors, centres, f"{tmp_path}/index", copies)
    found = S.match_many(spark.read.parquet(f"{tmp_path}/index"), centres, queries, 10, probes)
    assert set(found.columns) == {"cell", "external_id", "query_id", "similarity", "rank"}
    near = vectors.filter("embedding IS NOT NULL").withColumn("own", S._nearest_cells(centres, copies)("embedding"))
    probed = queries.filter("query_vector IS NOT NULL").withColumn("probed", S._nearest_cells(centres, probes)("query_vector"))
    pairs = near.crossJoin(probed).filter(F.arrays_overlap("own", "probed")).withColumn("s", S.cosine_pairs("embedding", "query_vector"))
    best = Window.partitionBy("query_id").orderBy(F.desc("s"), "external_id")
    want = pairs.withColumn("rank", F.row_number().over(best)).filter("rank <= 10")
    got = rows(found, "query_id", "rank", "external_id", "similarity")
    assert str(got) == str(rows(want, "query_id", "rank", "external_id", "s")) and len(got) > 50
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString(), "a row for each pair"


def test_blocks_of_a_cell_are_bounded_and_lose_nothing(spark, tmp_path):
    """One cell with more items than a block holds: each query meets them in several groups, k rows come out of each."""
    n = 3 * S.ITEM_BLOCK
    items = spark.range(n, numPartitions=4).select(
        F.col("id").alias("external_id"), F.array(F.lit(1.0), F.col("id") / n, F.lit(0.5)).cast("array<float>").alias("embedding"))
    S.write_index(items, [[1.0, 0.0, 0.0]], f"{tmp_path}/index")
    queries = items.filter("external_id % 1000 = 0").select(F.col("external_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    asked = queries.withColumn("cell", F.lit(0))
    best = S._best_of_blocks(spark.read.parquet(f"{tmp_path}/index"), asked, {0: 25}, 5)
    assert best.count() == 25 * 3 * 5
    found = S.match_many(spark.read.parquet(f"{tmp_path}/index"), [[1.0, 0.0, 0.0]], queries, 1, 1)
    similar = found.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("external_id") - F.col("query_id"))).alias("off")).first()
    assert similar.n == 25 and similar.off <= 1


def test_passages_are_the_same_on_both_candidate_paths(spark):
    dim = spark.createDataFrame([("S1", "the", False), ("S2", "that", False), ("S6", "was", True), ("S7", "of the", False)],
                                "subject string, alias string, ambiguous boolean")
    segments = A.segments(spark, SF)
    inline, joined = (rows(G.build_passages(segments, AliasSet(dim, n), cues=("by",)), "guid", "subject", "seg_idx", "words", "mentions") for n in (99, 0))
    assert inline == joined and len(inline) > 10


def test_one_subject_with_most_rows(spark):
    """Nine of ten rows in one group, spread over many partitions: nothing is lost or capped."""
    n = 40_000
    items = spark.range(n, numPartitions=16).select(
        F.col("id").cast("string").alias("external_id"), F.when(F.col("id") % 10 == 0, F.concat(F.lit("s"), F.col("id") % 70)).otherwise("hot").alias("subject"),
        ((F.col("id") * 7919) % 201 - 100).cast("int").alias("score"), (F.col("id") % 997).cast("double").alias("similarity"), F.col("id").alias("ingest_seq"))
    hot = R.subject_reading(items).filter("subject = 'hot'").first()
    assert hot.volume == n * 9 // 10
    picked = [r for r in R.pick_citations(items).filter("subject = 'hot'").orderBy("n").collect()]
    assert [r.score for r in picked] == [100] * 7 + [-100] * 7
    assert first_wins(items, "subject").count() == items.select("subject").distinct().count()
