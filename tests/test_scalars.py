from __future__ import annotations

import random

from conftest import rows
from pyspark.sql import functions as F

from opinara.functions import scalars as S
from opinara.functions import text as X
from opinara.functions.rounding import py_round


def test_rounding_agrees_with_python(spark):
    rng = random.Random(5)
    values = [2.675, 12.25, -12.25, 0.35, -0.35, 0.05, 0.15, 0.25, 1.005, 0.0, -0.04, 99.95, 1e-9, 123456.65]
    values += [rng.randint(-4000, 4000) / 20 for _ in range(2000)] + [rng.uniform(-1, 1) for _ in range(2000)]
    values += [rng.randint(-20000, 20000) / 20000 for _ in range(2000)] + [rng.randint(1, 900) / rng.randint(1, 900) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    out = df.select("v", *[py_round("v", d).alias(f"r{d}") for d in (1, 2, 3, 4)]).collect()
    for r in out:
        for d in (1, 2, 3, 4):
            assert r[f"r{d}"] == round(r.v, d), (r.v, d, r[f"r{d}"], round(r.v, d))


def test_rounding_keeps_nulls_and_nan(spark):
    out = spark.sql("select cast(null as double) a, double('nan') b").select(py_round("a", 1), py_round("b", 1)).first()
    assert out[0] is None and out[1] != out[1]


def test_recency_of_missing_and_future_times(spark):
    now = F.to_timestamp(F.lit("2024-01-02 00:00:00"))
    df = spark.sql("select timestamp '2024-01-01 12:00:00' ts union all select null union all select timestamp '2024-01-05 00:00:00'")
    assert rows(df.select(S.recency_factor("ts", now))) == [(0.5,), (1.0,), (1.0,)]


def test_week_starts_on_monday_and_calendar_is_newest_first(spark):
    df = spark.sql("select timestamp '2024-01-07 23:59:59' ts union all select timestamp '2024-01-08 00:00:00'")
    assert rows(df.select(S.bucket_key("ts", "week"))) == [("2024-01-01",), ("2024-01-08",)]
    cal = S.period_calendar(spark, "2024-03-15 10:00:00", "month", 3).collect()
    assert [c.label for c in cal] == ["2024-03", "2024-02", "2024-01"]
    assert cal[1].end_unix - cal[1].start_unix == 29 * 86400 - 1


def test_feed_dates(spark):
    texts = ["Mon, 01 Jan 2024 10:00:00 GMT", "1 Jan 2024 12:00:00 +0200", "2024-01-01T10:00:00Z", "nonsense", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = [str(r[0]) for r in df.select(S.feed_date("t").cast("string")).collect()]
    assert out == ["2024-01-01 10:00:00"] * 3 + ["None"] * 2


def test_html_entities_and_tags(spark):
    df = spark.createDataFrame([("<p>a&nbsp;b &hellip; &#x27;c&#39;</p>",), (None,), ("<b>x</b>\n y",)], "t string")
    assert [r[0] for r in df.select(X.strip_html("t")).collect()] == ["a b … 'c'", "", "x y"]


def test_headline_literals(spark):
    raw = ["b'plain'", 'b"it\'s"', "b'caf\\xc3\\xa9'", '"quoted words here"', "no literal at all", "", None, "12", "b'two' b'parts'"]
    want = ["plain", "it's", "café", "quoted words here", "no literal at all", "", "", "12", "twoparts"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i int, t string")
    out = df.select("i", X.clean_headline("t").alias("h")).orderBy("i").collect()
    assert [r.h for r in out] == want


def test_client_key(spark):
    df = spark.createDataFrame([(" 1.1.1.1 , 2.2.2.2", "p"), ("", "p"), (None, None), (" ,x", "q")], "xff string, peer string")
    assert [r[0] for r in df.select(S.client_key("xff", "peer")).collect()] == ["1.1.1.1", "p", "unknown", "q"]


def test_word_count_matches_split(spark):
    texts = ["a b  c", "", " \t", "x y z", "one two\nthree", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(X.word_count("t")).collect()] == [len((t or "").split()) for t in texts]


def test_rounding_of_large_numbers(spark):
    from opinara.functions.rounding import py_round

    values = [1e12 + 0.26, -1e12 - 0.26, 123456789012345.67, 9e14 + 0.5, 1e15 + 0.3, 5e18]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 1, 2):
        assert [r[0] for r in df.select(py_round("x", digits)).collect()] == [round(v, digits) for v in values]


def test_keys_are_stripped_of_unicode_blanks(spark):
    from opinara.functions.scalars import client_key, resolver_key

    row = spark.createDataFrame([("\u00a0\u3000 NVDA\u2003", "\u00a01.2.3.4 , x")], "t string, f string").select(
        resolver_key("t").alias("t"), client_key("f", "f").alias("c")).first()
    assert (row.t, row.c) == ("nvda", "1.2.3.4")
