from __future__ import annotations

import zlib

import numpy as np
import pytest

from opinara.llm import quality

from .cases import ODD_ROWS, docs_of, odd_docs

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def test_held_out_accuracy(spark):
    from opinara.llm.queries import QUERIES

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op3_quality_classifier"](spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    seen = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = ([s for s, y in seen if y == k] for k in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95
    assert np.mean([(s >= 0.7) == y for s, y in seen]) > 0.95


def test_held_out_labels_do_not_matter(spark, model):
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), turned)
    assert np.allclose(model.weights, other.weights) and np.allclose(model.values, other.values)


def test_cosines_approximate_a_gaussian_kernel(model):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(40, quality.STATISTICS))
    features = model.cosines(z * model.scale + model.centre)[:, :-1]
    distance = ((z[:, None] - z[None]) ** 2).sum(axis=2)
    assert np.abs(features @ features.T - np.exp(-distance / (2 * quality.STATISTICS))).mean() < 0.06


def test_statistics_do_not_depend_on_neighbours():
    texts = ["A b!! c", "", "x\n\ny | z", "é漢 $$$ A1"]

    def of(some):
        data = "".join(some).encode()
        return quality.statistics(np.frombuffer(data, np.uint8), np.cumsum([0, *(len(t.encode()) for t in some)]))
    assert np.allclose(of(texts), np.vstack([of([t]) for t in texts]))


def test_pooling_is_the_best_increasing_fit():
    rng = np.random.default_rng(4)
    for _ in range(50):
        n = rng.integers(1, 9, 6)
        good = np.array([rng.integers(0, k + 1) for k in n])
        _, values = quality.pool_adjacent(np.arange(6.0), good.astype(float), n.astype(float))
        assert (np.diff(values) > 0).all()
        rate = good / n
        best = [max(min(np.average(rate[a:b + 1], weights=n[a:b + 1]) for b in range(i, 6)) for a in range(i + 1)) for i in range(6)]
        assert sorted(set(np.round(best, 9))) == list(np.round(values, 9))


def test_odd_rows_and_labels(spark, model):
    docs = odd_docs(spark, "quality_score")
    scored = quality.score(docs, model).collect()
    assert len(scored) == len(ODD_ROWS) and all(0 <= r.quality_score <= 1 for r in scored)
    assert len({r.quality_score for r in scored if r.text == ODD_ROWS[0][1]}) == 1
    assert quality.score(docs.where("false"), model).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.keep_good(docs, none).count() == len(ODD_ROWS)
    assert quality.keep_good(docs, none).columns == docs.columns
    same = spark.createDataFrame([(1, 0), (3, 0), (None, 1), (5, None)], "doc_id long, quality int")
    assert quality.keep_good(docs, same).count() == 0
    repeated = spark.createDataFrame([(1, 0), (1, 1), (3, 0), (5, 1)], "doc_id long, quality int")
    assert quality.score(docs, quality.fit(docs, repeated)).count() == len(ODD_ROWS)


def test_empty_documents(spark, model):
    rows = quality.score(docs_of(spark, {1: None, 2: "", 3: "  "}), model).collect()
    assert len(rows) == 3 and rows[0].quality_score == rows[1].quality_score


def test_labelled_sample_is_the_lowest_hashes(spark):
    """The bound before the sort changes no choice, and leaves little more than the sample."""
    from pyspark.sql import functions as F

    from opinara.llm import common

    docs = spark.range(30_000).selectExpr("id as doc_id", "'x' as text")
    labels = spark.range(30_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    may = labels.where(~common.held_out(F.col("doc_id")))
    for most in (1, 500, 40_000):
        got = {r.doc_id for r in common.labelled(docs, labels, "quality", most).collect()}
        assert got == {r.doc_id for r in may.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()}
    total = may.count()
    assert may.where(F.xxhash64("doc_id") <= common.hash_bound(total, 500)).count() < 1_100
    assert common.labelled(docs, labels.where("false"), "quality", 5).count() == 0
