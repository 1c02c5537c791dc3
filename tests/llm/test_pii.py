from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from opinara.llm import pii

from .cases import ODD_ROWS, docs_of, odd_docs

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            value, digits = m.group(), re.sub("[^0-9]", "", m.group())
            fine = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in value.split(".")),
                    "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()
            if fine:
                out.append((m.start(), order, m.end(), kind))
    return sorted(out)


def spans_of(rows):
    return {r.doc_id: [tuple(s) for s in r.base_spans] for r in rows}


def test_base_spans_on_random_texts(spark):
    rng = random.Random(1)
    alphabets = ["a@.b-", "1.2 3-+()", "0 1-", "+1 (23) 45-67.89", "a1@.😀é \n", "4111 -"]
    texts = {i: "".join(rng.choice(alphabets[i % 6]) for _ in range(rng.randrange(80))) for i in range(400)}
    texts |= {1000: "a@b.c@d.e", 1001: "x@y.zz_w@q.com", 1002: "1.2.3.4.5.6.7.8.9", 1003: "007.0000255.1.256 7.8.9.10",
              1004: "4111 1111 1111 1111", 1005: "4111-1111-1111-1112", 1006: "+1 (509) 555-6973", 1007: "😀😀 a@b.cd ",
              1008: "mail a.b%c@d-e.f.g, 10.0.0.1", 1009: "99999999999.1.1.1", 1010: "4" * 19, 1011: "+12345678901234567"}
    rows = pii.find(docs_of(spark, texts), None).collect()
    assert spans_of(rows) == {i: brute(t) for i, t in texts.items()}


@pytest.mark.parametrize("unit", ["a", "1", "a@", "1.", "1 ", "+1(", "a.", "@a.", "a@b.c ", "(at) "])
def test_long_runs_end_soon(spark, unit):
    text = unit * 20_000
    rows = pii.find(docs_of(spark, {1: text, 2: "x@" + text, 3: "x@y" + ".z" * 20_000}), None).collect()
    assert [len(r.base_spans) for r in sorted(rows)] == [len(brute(text)), len(brute("x@" + text)), 1]


def test_expectation_maximisation_finds_reliable_labelers():
    rng = random.Random(2)
    counts = {}
    for _ in range(20_000):
        real = rng.random() < 0.7
        votes = tuple((1 if (rng.random() < good) == real else -1) if rng.random() < said else 0
                      for good, said in ((0.95, 1), (0.8, 0.9), (0.6, 0.5), (0.9, 0.7)))
        counts[votes] = counts.get(votes, 0) + 1
    prior, tables, _ = pii.expectation_maximisation(sorted(counts.items()), 200)
    assert abs(prior - 0.7) < 0.05
    right = [t[1][0] / (t[1][0] + t[-1][0]) for t in tables]
    assert right[0] > right[3] > right[1] > right[2]


def test_logistic_fits_rates():
    rows = [([1.0, 0.0], 0.9, 500.0), ([0.0, 1.0], 0.2, 500.0), ([0.0, 0.0], 0.5, 500.0)]
    w = pii.logistic(rows, ridge=1e-6)
    import math
    rate = [1 / (1 + math.exp(-z)) for z in (w[0] + w[2], w[1] + w[2], w[2])]
    assert all(abs(a - b) < 1e-3 for a, b in zip(rate, (0.9, 0.2, 0.5)))


def supervised(spark):
    rng = random.Random(4)
    texts = {}
    for i in range(300):
        n = [rng.randrange(10) for _ in range(10)]
        digits = "".join(map(str, n))
        texts[i] = (f"Call me, phone +1 ({digits[:3]}) {digits[3:6]}-{digits[6:]} or phone ({digits[:3]}) {digits[3:6]}-{digits[6:]} now. "
                    f"Mail me: u{i}@mail.example.com or mail u{i} (at) mail (dot) com today. "
                    f'token="{digits}{digits}" and key 12 3456 7890')
    return docs_of(spark, texts), texts


def test_method_adds_and_base_stays(spark):
    docs, texts = supervised(spark)
    model = pii.fit(docs)
    rows = pii.find(docs, model).collect()
    added = 0
    for r in rows:
        base, every = ([tuple(s) for s in c] for c in (r.base_spans, r.spans))
        assert base == brute(texts[r.doc_id]) and set(base) <= set(every) and every == sorted(every)
        extra = sorted(set(every) - set(base))
        assert all(a[2] <= b[0] or b[2] <= a[0] for a in extra for b in [*base, *(e for e in extra if e != a)])
        assert not any('token="' in texts[r.doc_id][max(0, s[0] - 9):s[0]] for s in extra)
        added += len(extra)
    assert added > 150


def test_added_spans_touch_nothing(spark):
    """The two scans against all pairs, over crowded spans that overlap, touch and repeat, more than a block of them."""
    rng = random.Random(8)
    rows = []
    for i in range(60):
        width = 60 if i % 2 else 3000

        def some(n):
            return sorted({(a := rng.randrange(width), k := rng.randrange(4), a + rng.randrange(1, 9), pii.KINDS[k]) for _ in range(n)})
        rows.append((i, some(rng.randrange(12) if i % 2 else 300), some(rng.randrange(25) if i % 2 else 400)))
    spans = "array<struct<start:int,order:int,end:int,kind:string>>"
    df = spark.createDataFrame(rows, f"i int, base {spans}, proposed {spans}")
    got = {r.i: [tuple(s) for s in r.every] for r in df.select("i", pii._with_added(F.col("base"), F.col("proposed")).alias("every")).collect()}
    for i, base, proposed in rows:
        free = [s for s in proposed if not any(b[0] < s[2] and s[0] < b[2] for b in base)]
        added = []
        for s in free:
            if not any(s[0] < a[2] for a in added):
                added.append(s)
        assert got[i] == sorted(base + added)


def test_text_dense_with_spans(spark):
    """A megabyte in which every few characters are a span or a candidate."""
    text = "a@b.cd x (at) y.de 1.2.3.4 " * 37_000
    every = pii.Model({}, 0.5, (0.0,) * pii.FEATURES + (5.0,))
    row = pii.find(docs_of(spark, {1: text}), every).select(F.size("base_spans").alias("base"), F.size("spans").alias("every")).first()
    assert (row.base, row.every) == (2 * 37_000, 3 * 37_000)


def test_odd_rows(spark):
    docs = odd_docs(spark, "spans")
    found = pii.find(docs, pii.fit(docs)).collect()
    assert len(found) == len(ODD_ROWS) and all(list(r.base_spans) == [] == list(r.spans) for r in found)
    cut = pii.redact(docs)
    assert cut.columns == docs.columns
    assert sorted(map(tuple, cut.collect()), key=repr) == sorted(
        ((d, t, a, b, n if t is None else len(t), x) for d, t, a, b, n, x in ODD_ROWS), key=repr)
    assert pii.redact(docs.where("false")).count() == 0


def test_redaction(spark):
    texts = {1: "😀 to a@b.cd, +1 (509) 555-6973 1.2.3.4.", 2: "4111 1111 1111 1111", 3: None, 4: "nothing"}
    got = {r.doc_id: r.text for r in pii.redact(docs_of(spark, texts)).collect()}
    assert got[2] == "[CARD]" and got[3] is None and got[4] == "nothing"
    assert got[1].startswith("😀 to [EMAIL], ") and "509" not in got[1] and got[1].endswith(".")


def test_query(spark):
    from opinara.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    df = QUERIES["op6_pii"](spark, sf)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
    for r in df.collect():
        base = brute(texts[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for a, _, b, k in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[3] == k for s in base) for k in PATTERNS)
        assert set(said.split(",")) <= set(r.spans.split(",")) | {""}
