from __future__ import annotations

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from opinara.operators import scoring as C

RELEVANT = json.dumps({"relevant": True, "score": 42, "rationale": "up"})
IRRELEVANT = json.dumps({"relevant": False, "score": 0, "rationale": "off"})


def responses(spark, bodies):
    """``bodies``: text, or an error class as a number."""
    data = [(f"item-{i}", None if isinstance(b, int) else b, str(b) if isinstance(b, int) else None) for i, b in enumerate(bodies)]
    return spark.createDataFrame(data, "custom_id string, body string, error_class string")


def kept(spark, bodies):
    frame = responses(spark, bodies)
    C.require_working_scorer(frame, "test")
    return C.parse_stance(frame).filter("drop_reason is null").count()


def test_fatal_errors_raise(spark):
    for code in (400, 401, 403, 404):
        with pytest.raises(C.ScoringFailed, match=str(code)):
            kept(spark, [RELEVANT] * 19 + [code])


def test_irrelevance_is_not_an_error(spark):
    assert kept(spark, [IRRELEVANT] * 20) == 0
    assert kept(spark, [RELEVANT] * 20) == 20


def test_scattered_failures_pass_and_outages_raise(spark):
    assert kept(spark, [429, 429] + [RELEVANT] * 18) == 18
    assert kept(spark, [429] * 5 + [RELEVANT] * 15) == 15          # exactly a quarter is tolerated
    with pytest.raises(C.ScoringFailed, match="coverage"):
        kept(spark, [429] * 20)


def test_garbage_only_drops_its_item(spark):
    assert kept(spark, ["this is not json at all"] * 8) == 0
    bodies = ['{"relevant": true, "score": "17"}', '{"relevant": true, "score": 17.9}', '{"relevant": true, "score": "x"}', '{"relevant": true}',
              "[1, 2]", "null", '{"relevant": "yes", "score": -5}', '{"score": 3}']
    out = C.parse_stance(responses(spark, bodies)).select("custom_id", "score", "drop_reason").orderBy("custom_id").collect()
    assert [(r.score, r.drop_reason) for r in out] == [
        (17, None), (17, None), (None, "no score"), (None, "no score"), (None, "unparseable"), (None, "unparseable"), (-5, None), (3, "irrelevant")]


def test_prefilled_answers(spark):
    out = C.parse_stance(responses(spark, [RELEVANT[1:]]), prefill="{").first()
    assert out.score == 42 and out.drop_reason is None


def test_alignment_reports_what_is_missing(spark):
    items = spark.range(4).select(F.col("id").alias("idx"))
    landed = C.parse_stance(responses(spark, [RELEVANT, IRRELEVANT, 429]))
    good, dropped = C.align_responses(items, landed)
    assert rows(good, "idx", "score") == [(0, 42)]
    assert rows(dropped, "idx", "drop_reason") == [(1, "irrelevant"), (2, "error"), (3, "missing")]


def test_request_text(spark):
    df = spark.createDataFrame([(7, "Nvidia", "T", "x" * 2000)], "idx int, display string, title string, text string")
    r = C.stance_requests(df).first()
    assert r.custom_id == "item-7" and r.content == "SUBJECT: Nvidia\n\nPOST TITLE: T\n\nPOST BODY: " + "x" * 1500


def test_python_rules_of_truth_and_int(spark):
    cases = [("true", "5", 5), ('"false"', "5", 5), ("[]", "5", None), ("{}", "5", None), ("[0]", "5", 5), ("0", "5", None), ("0.5", "5", 5),
             ('""', "5", None), ("null", "5", None), ("true", '"42"', 42), ("true", '" 42 "', 42), ("true", '"42.7"', None), ("true", "42.7", 42),
             ("true", "-42.7", -42), ("true", "true", 1), ("true", "false", 0), ("true", "null", None), ("true", "[1]", None), ("1", "1e2", 100)]
    bodies = [f'{{"relevant": {r}, "score": {s}}}' for r, s, _ in cases]
    df = spark.createDataFrame([(f"{i:02}", b, None) for i, b in enumerate(bodies)], "custom_id string, body string, error_class string")
    out = C.parse_stance(df).orderBy("custom_id").collect()
    assert [r.score if r.drop_reason is None else None for r in out] == [want for *_, want in cases]


def test_engagement_goes_by_json_type(spark):
    from opinara.operators.records import json_engagement

    cases = [('{"post": {"score": "a"}, "score": 5}', 5), ('{"score": "7"}', 0), ('{"score": 7.9}', 7), ('{"score": -7.9}', -7), ('{"score": true}', 1),
             ('{"score": null}', 0), ("{}", 0), ("no json", 0), (None, 0), ('{"score": [3]}', 0)]
    df = spark.createDataFrame(list(enumerate(p for p, _ in cases)), "i int, p string").select("i", json_engagement("p").alias("e"))
    assert [r.e for r in df.orderBy("i").collect()] == [e for _, e in cases]
