from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from opinara.llm import linededup

from .cases import ODD_ROWS, docs_of, odd_docs


def brute(texts, percent=80):
    lines = [(d, k, frozenset(w for w in re.split(r"[\x20\x09-\x0D]+", line) if w))
             for d, t in sorted(texts.items()) for k, line in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    return {(d, k) for i, (d, k, s) in enumerate(lines)
            if any(100 * len(s & t) >= percent * len(s | t) for _, _, t in lines[:i])}


def found(df):
    return {(r.doc_id, r.line) for r in df.collect()}


def texts_of(seed, docs=40):
    rng = random.Random(seed)
    lines = []
    texts = {}
    for d in range(docs):
        mine = []
        for _ in range(rng.randrange(6)):
            if lines and rng.random() < 0.5:
                words = rng.choice(lines)[:]
                for _ in range(rng.randrange(4)):
                    act = rng.random()
                    if act < 0.4 and words:
                        words[rng.randrange(len(words))] = f"n{rng.randrange(9999)}"
                    elif act < 0.7:
                        words.append(f"n{rng.randrange(9999)}")
                    elif len(words) > 1:
                        words.pop(rng.randrange(len(words)))
                rng.shuffle(words)
            else:
                words = [f"w{int(rng.paretovariate(0.7)) % 500}" for _ in range(rng.choice((0, 1, 4, 5, 9, 30, 120)))]
            lines.append(words)
            mine.append(rng.choice((" ", "\t", "  ")).join(words))
        texts[d * 3 % 41] = "\n".join(mine)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    texts = texts_of(seed)
    assert found(linededup.later_matches(docs_of(spark, texts))) == brute(texts)


def test_second_lookup_finds_the_same(spark, monkeypatch):
    """Without first candidates everything is found by the lookup that has no limit."""
    monkeypatch.setattr(linededup, "FIRST", 0)
    texts = texts_of(3)
    assert found(linededup.later_matches(docs_of(spark, texts))) == brute(texts)


def test_many_near_copies_of_a_line(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(20)]
    texts = {d: " ".join(w if rng.random() > 0.06 else f"x{rng.randrange(999)}" for w in base) for d in range(150)}
    assert found(linededup.later_matches(docs_of(spark, texts))) == brute(texts)


def test_other_thresholds(spark):
    texts = texts_of(7, 25)
    for percent in (60, 95):
        assert found(linededup.later_matches(docs_of(spark, texts), percent)) == brute(texts, percent)


def test_odd_rows(spark):
    docs = odd_docs(spark, "lines")
    assert found(linededup.later_matches(docs)) == brute({d: t for d, t, *_ in ODD_ROWS if d is not None})
    cut = linededup.drop_repeated_lines(docs)
    assert cut.columns == docs.columns
    rows = cut.collect()
    assert len(rows) == len(ODD_ROWS)
    assert sorted(((r.doc_id, r.text, r.lines) for r in rows), key=repr) == sorted(
        ((d, "" if d == 7 else t, extra) for d, t, _, _, _, extra in ODD_ROWS), key=repr)
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
    gone = linededup.drop_repeated_lines(docs, drop_emptied=True).collect()
    assert sorted((r.doc_id for r in gone), key=repr) == sorted((d for d, *_ in ODD_ROWS if d != 7), key=repr)
    assert linededup.later_matches(docs.where("false")).count() == 0
    assert linededup.drop_repeated_lines(docs.where("false")).count() == 0


def test_query_counts_lines(spark):
    from opinara.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = brute(texts)
    for r in QUERIES["op7_line_dedup"](spark, "/root/testdata/sf0.001").collect():
        lines = sorted(k for d, k in want if d == r.doc_id)
        assert (r.n_lines, r.n_removed, r.removed) == (len(texts[r.doc_id].split("\n")), len(lines), ",".join(map(str, lines)))


def test_bitmaps_of_all_widths(spark):
    """Lines around and above the sizes where bitmaps get wider, near each other and not."""
    rng = random.Random(11)
    texts, at = {}, 0
    for size in (90, 97, 110, 380, 390, 460, 700):
        base = [f"v{rng.randrange(3000)}" for _ in range(size)]
        for share in (0.0, 0.05, 0.11, 0.3):
            texts[at] = " ".join(w if rng.random() > share else f"z{rng.randrange(9999)}" for w in base[:size - rng.randrange(8)])
            at += 1
    want = brute(texts)
    assert len(want) >= 7
    assert found(linededup.later_matches(docs_of(spark, texts))) == want


def template_lines(n, seed=13):
    """Lines of one template and, of every third, a line that shares its two rarest words only."""
    rng = random.Random(seed)
    texts = {}
    for d in range(n):
        rest = [f"r{rng.randrange(40)}" for _ in range(8)] if d % 3 == 0 else [f"t{i}" for i in range(8)] + [f"x{d}"]
        texts[d * 7 % 997] = " ".join(["hot1", "hot2", *rest])
    return texts


def posted_by(texts, block, monkeypatch, only=None, probe_blocks=1):
    """Rows that the map step makes of texts in one batch."""
    monkeypatch.setattr(linededup, "BLOCK", block)
    counts = np.ones(2**linededup.FREQUENCY_BITS, np.int64)
    blocks = np.full(2**linededup.FREQUENCY_BITS, -(-len(texts) // block), np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array(list(texts), pa.int64()), pa.array(list(texts.values()))], ["doc_id", "text"])
    run = linededup._extract(linededup._rarity(counts), 80, 24, blocks, only, probe_blocks)
    return [(k, c, b) for out in run(iter([batch])) for k, c, b in zip(*(x.to_pylist() for x in out.columns))]


def test_hot_words_are_dealt_to_blocks(monkeypatch):
    texts = {d: " ".join([f"t{i}" for i in range(9)] + [f"x{d}"]) for d in range(400)}
    lists = [len(b) // linededup.POSTING[0].itemsize for k, _, b in posted_by(texts, 20, monkeypatch) if k >= linededup.POSTINGS]
    assert sum(lists) == 3 * 400
    assert max(lists) < 60
    assert max(len(b) // linededup.POSTING[0].itemsize for k, _, b in posted_by(texts, 400, monkeypatch)
               if k >= linededup.POSTINGS) == 400


def test_lines_of_a_template_are_compared_until_decided(monkeypatch):
    """Pairs compared grow with the lines, not with their square."""
    texts = {d: " ".join([f"t{i}" for i in range(9)] + [f"x{d}"]) for d in range(3000)}
    rows = posted_by(texts, 3000, monkeypatch)
    compared = []
    count = np.bitwise_count
    monkeypatch.setattr(linededup.np, "bitwise_count", lambda x: compared.append(len(x)) or count(x))
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])],
                                       ["kind", "cell", "blob"])
    out = pa.Table.from_batches(linededup._resolve(80, linededup.FIRST)(iter([batch])))
    assert len({r["doc"] for r in out.to_pylist() if r["kind"] == linededup.POSTINGS}) == 2999
    assert sum(compared) < 200 * 3000


@pytest.mark.parametrize("block", [4, 25])
def test_blocks_find_the_same(spark, monkeypatch, block):
    monkeypatch.setattr(linededup, "BLOCK", block)
    texts = template_lines(120) | {1000 + d: t for d, t in texts_of(17).items()}
    want = brute(texts)
    docs = docs_of(spark, texts)
    counts = linededup.word_frequencies(docs)
    assert linededup._blocks_of_words(docs, counts, linededup._rarity(counts), 80).max() > 1
    assert found(linededup.later_matches(docs)) == want


def test_sets_of_two_bitmap_widths_meet(spark):
    texts = {}
    for d in range(12):
        base = [f"g{d}w{i}" for i in range(100)]
        texts[2 * d], texts[2 * d + 1] = " ".join(base[:95]), " ".join(base)
    want = {(2 * d + 1, 0) for d in range(12)}
    assert brute(texts) == want
    assert found(linededup.later_matches(docs_of(spark, texts))) == want


def test_repeats_within_batches_are_spread(monkeypatch):
    """Lines that repeat an equal line of their batch go to many cells, a bounded number of them to each."""
    cells, sent = {}, 0
    for batch in range(20):
        texts = {batch * 1000 + d: "\n".join(["one common line"] * 30) for d in range(200)}
        for k, c, b in posted_by(texts, 10**6, monkeypatch):
            if k == linededup.GONE:
                n = len(b) // linededup.LINE.itemsize
                cells[c] = cells.get(c, 0) + n
                sent += n
    assert sent == 20 * (200 * 30 - 1)
    assert max(cells.values()) < sent / 10


def test_a_line_is_not_its_own_match_in_the_second_lookup(spark, monkeypatch):
    """Rows that repeat a doc_id with similar texts: the line has candidates, but no earlier line."""
    monkeypatch.setattr(linededup, "FIRST", 0)
    base = [f"s{i}" for i in range(20)]
    rows = [(5, " ".join(base)), (5, " ".join(base + ["more"])), (9, " ".join(base + ["other"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(linededup.later_matches(docs)) == {(9, 0)}
