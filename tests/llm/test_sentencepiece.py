from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from opinara.llm import sentencepiece_bpe as sp
from opinara.llm.common import text_slices
from opinara.llm.queries import tokenizer_path

from .cases import ODD_ROWS, odd_docs

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())


@pytest.fixture(scope="module")
def vocabulary():
    return sp.Vocabulary(tokenizer_path())


def encoded(vocabulary, texts):
    out = []
    for _, _, data, bounds in text_slices(pc.replace_substring(pa.array(texts), sp.BLANK, " ")):
        ids, counts = vocabulary.encode(data, bounds)
        out += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    return out


ALPHABETS = ["abcdefghij klmnop\n\t.,'", "the and io ss", "0123456789 ab", "▁ a▁", "漢字테스트 😀🏽́ é", "<0x0A></s>Aa ", "aA  　\x00\x85"]


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_equals_the_library(vocabulary, library, alphabet):
    rng = random.Random(alphabet)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(300)]
    texts += ["", " ", "  ", "a", "aaaa" * 99, " " * 99, "the" * 400]
    assert encoded(vocabulary, texts) == library.encode(texts, add_eos=True)


def test_memory_of_words_is_bounded(vocabulary, library, monkeypatch):
    monkeypatch.setattr(sp, "REMEMBERED", 50)
    texts = [f"w{i}x y{i * 7}" for i in range(300)]
    for at in range(0, 300, 20):
        assert encoded(vocabulary, texts[at:at + 20]) == library.encode(texts[at:at + 20], add_eos=True)
        assert len(vocabulary.slots) <= 50 + 60


def test_decodes_any_ids(vocabulary, library):
    rng = np.random.default_rng(5)
    for _ in range(1500):
        n = rng.integers(0, 10)
        ids = np.where(rng.random(n) < 0.6, rng.integers(0, 300, n), rng.integers(0, 32000, n))
        assert vocabulary.decode(ids, np.array([n])) == [library.decode(ids.tolist())], ids


def test_odd_rows(spark, library):
    model = tokenizer_path()
    both = sp.decode(sp.encode(odd_docs(spark, "ids"), model), model).collect()
    want = sorted(((d, library.encode(t or "", add_eos=True)) for d, t, *_ in ODD_ROWS), key=repr)
    assert sorted(((r.doc_id, list(r.ids)) for r in both), key=repr) == want
    assert all(r.text == library.decode(list(r.ids)) for r in both)
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert [r.text for r in sp.decode(none, model).collect()] == [""]
    assert sp.encode(odd_docs(spark, "ids").where("false"), model).count() == 0


def test_real_texts(vocabulary, library, spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert encoded(vocabulary, texts) == library.encode(texts, add_eos=True)
