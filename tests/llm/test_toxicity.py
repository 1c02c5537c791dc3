from __future__ import annotations

import zlib

import numpy as np

from opinara.llm import toxicity

from .cases import ODD_ROWS, docs_of, odd_docs

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    from opinara.llm.queries import QUERIES

    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = {r.doc_id: r for r in QUERIES["op5_toxicity"](spark, SF).collect()}
    assert len(rows) == 1000 and all(0 <= r.expected_severity <= 3 for r in rows.values())
    english = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").collect()}
    seen = [(rows[d].toxic, y) for d, y in labels.items() if zlib.crc32(str(d).encode()) % 4 == 2 and d in english]
    assert np.mean([x == y for x, y in seen]) > 0.95
    assert np.mean([x for x, y in seen if y == 0] or [0]) < 0.03


def test_gradient_is_that_of_the_likelihood():
    """The fit reaches a point that no small step of any parameter improves."""
    rng = np.random.default_rng(1)
    n, slots = 400, 4
    x = rng.integers(0, 3, (n, slots)).astype(float)
    linear = x @ np.array([1.0, -1.0, 0.5, 0.0])
    grade = np.searchsorted([0.5, 1.5, 2.5], linear + rng.logistic(size=n))
    row, slot = np.nonzero(x)
    weights, cuts = toxicity.fit_ordinal(row, slot, x[row, slot], grade, slots, steps=3000)
    assert (np.diff(cuts) > 0).all()

    def loss(w, c):
        s = np.column_stack([np.ones(n), 1 / (1 + np.exp(-(x @ w)[:, None] + c)), np.zeros(n)])
        return -np.log(s[np.arange(n), grade] - s[np.arange(n), grade + 1]).mean() + 0.5e-4 * (w**2).sum()
    best = loss(weights, cuts)
    for k in range(slots + 3):
        for step in (-0.05, 0.05):
            moved = np.concatenate([weights, cuts])
            moved[k] += step
            assert loss(moved[:slots], moved[slots:]) > best - 1e-6
    assert abs(weights[0] - 1) < 0.3 and abs(weights[1] + 1) < 0.3


def _trained(spark):
    texts = {i: f"plain words number{i} here" + (" vile" * (1 + i % 3) + " rotten" * (i % 4) if i % 5 == 0 else "") for i in range(200)}
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in texts], "doc_id long, toxic int")
    return toxicity.fit(docs_of(spark, texts), labels)


def test_severity_grows_with_the_telling_words(spark):
    model = _trained(spark)
    texts = {1: "plain words", 2: "plain vile words", 3: "vile rotten " * 5, 4: "VILE, Rotten!"}
    rows = {r.doc_id: r for r in toxicity.severity(docs_of(spark, texts), model).collect()}
    assert rows[1].expected_severity < rows[2].expected_severity < rows[3].expected_severity
    assert [rows[k].toxic for k in (1, 2, 3, 4)] == [0, 1, 1, 1]
    assert rows[1].grade == 0 and rows[3].grade == 3


def test_odd_rows(spark):
    model = _trained(spark)
    rows = toxicity.severity(odd_docs(spark, "toxic"), model).collect()
    assert len(rows) == len(ODD_ROWS) and not any(r.toxic for r in rows)
    assert toxicity.severity(odd_docs(spark, "toxic").where("false"), model).count() == 0
    for labels in ([], [(1, 0)], [(1, 1), (None, 0), (3, None)]):
        table = spark.createDataFrame(labels, "doc_id long, toxic int")
        silent = toxicity.fit(odd_docs(spark, "toxic"), table)
        assert not any(r.toxic for r in toxicity.severity(odd_docs(spark, "toxic"), silent).collect())


def test_the_scan_for_labelled_rows_is_not_narrowed(spark, monkeypatch):
    """All documents are read with their own partitioning; only the saved sample is coalesced."""
    tasks = []

    class Stop(Exception):
        pass

    def first(df, name):
        tasks.append(df.rdd.getNumPartitions())
        raise Stop
    monkeypatch.setattr(toxicity, "saved", first)
    docs = spark.range(400).selectExpr("id as doc_id", "'some words' as text").repartition(20)
    labels = spark.range(400).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    try:
        toxicity.fit(docs, labels)
    except Stop:
        pass
    assert tasks == [20]
