from __future__ import annotations

import re

import pytest

import corpus_pipeline
from opinara.llm import queries

from .cases import odd_docs
from .test_linededup import brute as repeated_lines
from .test_minhash import brute as near_groups
from .test_pii import brute as personal

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and the result of every stage, written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        result = spark.read.parquet(path)
        out.append((docs, result))
        docs = result
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_all_but_the_last_keep_the_columns(stages):
    for before, after in stages[:-1]:
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert all(r.n_chars == len(r.text) for r in after.collect())


def test_quality_keeps_clean_documents(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = texts(stages[0][1])
    assert set(kept.items()) <= set(texts(stages[0][0]).items())
    good = [d for d, y in labels.items() if y == 1]
    assert sum(d in kept for d in good) > 0.95 * len(good)
    assert sum(d in kept for d, y in labels.items() if y == 0) <= 0.3 * sum(y == 0 for y in labels.values())


def test_lines(stages):
    before, after = (texts(x) for x in stages[1])
    gone = repeated_lines(before)
    cut = {d: "\n".join(line for k, line in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in before.items()}
    assert after == {d: t for d, t in cut.items() if t.split() or t == before[d]}


def test_near_duplicates(stages):
    before, after = (texts(x) for x in stages[2])
    assert after == {d: before[d] for d, (_, _, kept) in near_groups(before, 5).items() if kept}


def test_personal_data(stages):
    before, after = (texts(x) for x in stages[3])
    assert before.keys() == after.keys()
    for d, t in after.items():
        assert not personal(t) and (bool(personal(before[d])) or re.search(r"\[[A-Z]+\]", t) or t == before[d])


def test_packing(stages):
    before, packed = stages[4]
    total = {}
    for r in packed.collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) + 1 for d, t in texts(before).items()}


def test_run_is_all_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[-1][1].collect()))


def test_stages_take_odd_and_empty_documents(spark):
    docs = odd_docs(spark, "notes").drop("notes")
    for given in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            result = stage(spark, given, SF)
            assert (result.count() > 0) == (given.count() > 0), name


def test_every_operator_has_its_query():
    import __spark_entry__

    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(queries.SQL) <= set(__spark_entry__.oracle_sql())
