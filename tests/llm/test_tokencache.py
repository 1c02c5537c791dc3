from __future__ import annotations

import public_tokenizers
import pytest

from opinara.llm import tokencache
from opinara.llm.tokencache import token_counts

from .cases import LONG, ODD_ROWS, docs_of, odd_docs

MODEL = public_tokenizers.path("piece_bpe_32k.model")
JSON = public_tokenizers.path("byte_bpe_50k.json")


def library(path, texts):
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        return [len(model.encode(t, add_special_tokens=False).ids) for t in texts]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [len(model.encode(t)) for t in texts]


def by_id(row):
    return row[0] is None, row


def counted(docs, path, cache):
    return sorted((tuple(r) for r in token_counts(docs, path, cache).collect()), key=by_id)


@pytest.mark.parametrize("path", [MODEL, JSON])
def test_odd_rows_equal_the_library(spark, tmp_path, path):
    texts = [r[1] or "" for r in ODD_ROWS]
    want = sorted(((r[0], len(t.encode()), n) for r, t, n in zip(ODD_ROWS, texts, library(path, texts))), key=by_id)
    assert counted(odd_docs(spark, "digest"), path, str(tmp_path / "c")) == want
    assert counted(odd_docs(spark, "n_tokens").limit(0), path, str(tmp_path / "d")) == []


def test_strings_of_special_tokens_and_blank_signs(spark, tmp_path):
    texts = ["a <|endoftext|> b", "<s> x </s>", "▁▁a▁", "  a ", " ", "▁", "a\tb\r\n c", "ﬁ Å é", "\u0000", LONG]
    for path in (MODEL, JSON, public_tokenizers.path("word_bpe_49k.json")):
        got = counted(docs_of(spark, texts), path, str(tmp_path / path[-8:-5]))
        assert [r[2] for r in got] == library(path, texts)


def encoded(spark, cache):
    return spark.read.parquet(cache).count()


def test_only_distinct_misses_are_encoded(spark, tmp_path):
    cache = str(tmp_path / "cache")
    first = [f"text number {i % 40}" for i in range(200)] + ["hot"] * 150
    assert [r[2] for r in counted(docs_of(spark, first), MODEL, cache)] == library(MODEL, first)
    assert encoded(spark, cache) == 41
    again = first + ["something new", "something▁new"]
    assert [r[2] for r in counted(docs_of(spark, again), MODEL, cache)] == library(MODEL, again)
    assert encoded(spark, cache) == 42
    counted(docs_of(spark, first), JSON, cache)  # another version has rows of its own
    assert encoded(spark, cache) == 83
    assert {r.tokenizer for r in spark.read.parquet(cache).select("tokenizer").distinct().collect()} == {
        tokencache.version_digest(MODEL), tokencache.version_digest(JSON)}


def test_counts_come_from_the_cache(spark, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    docs = docs_of(spark, ["one two three", "four"])
    want = counted(docs, MODEL, cache)
    spark.read.parquet(cache).write.mode("append").partitionBy("tokenizer").parquet(cache + "2")
    spark.read.parquet(cache).write.mode("append").partitionBy("tokenizer").parquet(cache + "2")
    monkeypatch.setattr(tokencache, "add_missing", lambda *a: pytest.fail("nothing is missing"))
    assert counted(docs, MODEL, cache) == want
    assert counted(docs, MODEL, cache + "2") == want  # the same text from two writers counts once


def test_many_misses_are_joined_by_a_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokencache, "BROADCAST_KEYS", 5)
    texts = [f"word {i % 60}" for i in range(300)]
    assert [r[2] for r in counted(docs_of(spark, texts), MODEL, str(tmp_path / "c"))] == library(MODEL, texts)
