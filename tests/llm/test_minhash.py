from __future__ import annotations

import random
import re

import numpy as np
import pytest

from opinara.llm import minhash

from .cases import ODD_ROWS, docs_of, odd_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < width:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1))


def brute(texts, width, percent=80):
    sets = {i: shingles(t, width) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in texts}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def drifting(seed, groups=6, size=25):
    """Groups of texts that drift apart by few words at a time, so that links form chains and stars."""
    rng = random.Random(seed)
    texts, at = {}, 0
    for _ in range(groups):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice((6, 30, 90)))]
        for _ in range(size):
            if rng.random() < 0.6:
                words = words[:]
                words[rng.randrange(len(words))] = f"w{rng.randrange(400)}"
            texts[at] = " ".join(words if rng.random() < 0.9 else [w.upper() for w in words])
            at += 1
    ids = list(texts)
    rng.shuffle(ids)
    return dict(zip(ids, texts.values()))


@pytest.mark.parametrize("width", [2, 5])
def test_equals_all_pairs(spark, width):
    texts = drifting(width)
    assert found(minhash.near_duplicates(docs_of(spark, texts), width)) == brute(texts, width)


def test_small_blocks_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    texts = {}
    for i in range(80):  # near the base, often too far from each other
        words = base[:]
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(60)] = f"c{rng.randrange(1000)}"
        texts[i] = " ".join(words)
    assert found(minhash.near_duplicates(docs_of(spark, texts), 2)) == brute(texts, 2)


def test_estimates_are_corrected_for_collisions(spark):
    rng = np.random.default_rng(3)
    for share in (0.3, 0.6, 0.9):
        common = rng.integers(0, 2**63, int(400 * share)).astype(np.uint64)
        rest = rng.integers(0, 2**63, 2 * (400 - len(common))).astype(np.uint64)
        sets = [np.sort(np.concatenate([common, part])) for part in np.split(rest, 2)]
        true = len(common) / (len(common) + len(rest))
        _, bits = minhash._signatures(sets)
        row = spark.createDataFrame([(bits[0].tolist(), bits[1].tolist())], "x array<long>, y array<long>")
        assert abs(row.select(minhash.estimated_similarity("x", "y")).first()[0] - true) < 0.15


def test_odd_rows(spark):
    docs = odd_docs(spark, "component_id")
    rows = minhash.near_duplicates(docs, 2).collect()
    assert len(rows) == len(ODD_ROWS)
    want = brute({d: t for d, t, *_ in ODD_ROWS if d is not None}, 2)
    for r in rows:
        if r.doc_id is None:
            assert (r.component_id, r.kept) == (None, False)
        else:
            assert (r.n_shingles, r.component_id, r.kept) == want[r.doc_id]
    assert want[7][1] == 1
    assert minhash.near_duplicates(docs.where("false")).count() == 0
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 1, 2, 3, 4, 5, 6, None, None], key=repr)


def test_chance_agreement_is_independent():
    """Sets without a common shingle agree in about a quarter of the low bits, never in all or none."""
    sets = [np.array([v], np.uint64) for v in np.random.default_rng(4).integers(0, 2**63, 400)]
    _, bits = minhash._signatures(sets)
    z = bits.view(np.uint64)[::2] ^ bits.view(np.uint64)[1::2]
    same = 1 - np.bitwise_count((z | (z >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1) / minhash.HASHES
    assert abs(same.mean() - 0.25) < 0.01
    assert same.std() < 0.05


def test_small_sets_are_confirmed_whatever_the_estimate(spark, monkeypatch):
    monkeypatch.setattr(minhash, "_lowest_agreement", lambda threshold: 2.0)
    texts = {}
    for i in range(30):
        words = [f"q{i}n{k}" for k in range(6)]
        texts[2 * i], texts[2 * i + 1] = " ".join(words), " ".join(words[:5])
    assert found(minhash.near_duplicates(docs_of(spark, texts), 2)) == brute(texts, 2)


def test_near_copies_are_linked_before_blocks(spark, monkeypatch):
    """Copies of which many are no match of their bucket's smallest id: blocks get next to none of them."""
    import random

    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = []
    for i in range(600):
        words = list(base)
        for _ in range(rng.randint(3, 9)):
            words[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        texts.append((i, " ".join(words)))
    dealt, plain = [], minhash.saved

    def counting(df, name):
        out = plain(df, name)
        if name == "unsettled":
            dealt.append(out.count())
        return out
    monkeypatch.setattr(minhash, "saved", counting)
    out = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(8)).collect()
    assert {r.component_id for r in out} == {0} and dealt[0] <= len(texts)
