"""End-to-end plans, and what their physical plans must and must not contain."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

import pytest
from conftest import rows
from pyspark.sql import functions as F

from opinara import adapters as A
from opinara import schemas
from opinara.operators import embed, scoring
from opinara.operators.mentions import AliasSet
from opinara.operators.readings import pick_citations, subject_reading
from opinara.operators.search import semantic_search
from opinara.operators.store import OpinionStore
from opinara.plans import daily, headlines, nightly, study
from opinara.sources.sinks import first_wins
from opinara.sources.tables import headlines_long

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def plan_of(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def podcast(spark):
    talk = "Nvidia is the trade and Nvidia has the margins " + "so we keep talking about it " * 25
    segments = spark.createDataFrame([(g, i, 30.0 * i, 30.0 * i + 30, "Speaker 1", talk if i == 1 else "just filler words here") for g in ("e1", "e2", "e3") for i in range(3)], schemas.SEGMENT)
    episodes = spark.createDataFrame([(g, "Show", 0, i, t, T0, f"https://a/{g}.mp3", None, "") for i, (g, t) in enumerate(
        [("e1", "Nvidia again"), ("e2", "Gardening"), ("e3", "More Nvidia"), ("e4", "Nvidia without audio text")])], schemas.EPISODE)
    aliases = AliasSet(spark.createDataFrame([("NVDA", "nvidia", False)], "subject string, alias string, ambiguous boolean"))
    dim = spark.createDataFrame([("nvidia", "Nvidia", "stock", True, "NVDA", None, None, [], [], "Nvidia", 0)], schemas.SUBJECT_DIM)
    return episodes, segments, aliases, dim


def scorer(body: str, error_class: str | None):
    """A stand-in model that gives every request the same answer."""
    def run(batches):
        for batch in batches:
            yield batch[["custom_id"]].assign(body=body, error_class=error_class)
    return run


def test_nightly_ingest_and_refresh(spark, tmp_path, podcast):
    episodes, segments, aliases, dim = podcast
    store = OpinionStore(spark, str(tmp_path))
    now = F.lit(T0 + timedelta(days=40)).cast("timestamp")
    good_scorer, broken_scorer = scorer(json.dumps({"relevant": True, "score": 30, "rationale": "r"}), None), scorer("invalid key", "401")
    run = lambda model, budget: nightly.ingest(spark, store, episodes, segments, aliases, dim, model, embed.embed_hashed, now, budget)
    with pytest.raises(scoring.ScoringFailed):
        run(broken_scorer, 5)
    assert store.ledger().count() == 0 and store.items().count() == 0
    assert run(good_scorer, 1) == 1
    assert rows(store.ledger(), "guid", "status", "n_items") == [("e1", "ok", 1), ("e2", "skipped", 0)]      # e3, e4 wait for the next run
    assert run(good_scorer, 5) == 1
    assert rows(store.ledger(), "guid", "status", "detail", "n_passages") == [
        ("e1", "ok", None, 1), ("e2", "skipped", "no covered subject in metadata", 0), ("e3", "ok", None, 1), ("e4", "skipped", "no transcript available", 0)]
    assert run(good_scorer, 5) == 0
    subjects = spark.createDataFrame([("NVDA", "NVDA", "Nvidia", "stock")], "subject string, proxy string, display string, asset_type string")
    prices = spark.createDataFrame([("NVDA", "2024-01", 10.0)], "symbol string, period string, close double")
    old = subjects.select("subject", now.alias("computed_at"))
    for f in schemas.READING.fields:
        if f.name not in old.columns:
            old = old.withColumn(f.name, F.lit(None).cast(f.dataType))
    store.save_readings(old)
    later = F.lit(T0 + timedelta(days=42)).cast("timestamp")
    nightly.refresh(store, subjects, prices, later)
    r = store.latest_reading("NVDA").first()
    assert r.volume == 2 and r.consensus_score == 30.0 and [c.n for c in r.citations] == [1, 2] and r.backtest.note.startswith("too few")
    assert store.history("NVDA").count() == 2


def test_daily_from_raw_to_row(spark, tmp_path):
    raw = [("news:x", None, f"t{i}", "body " * 200, "", T0 + timedelta(hours=i), (float(i), None, None, None, None), i * 7) for i in range(5)]
    canonical, requests = daily.requests_for(spark.createDataFrame(raw, schemas.RAW_RECORD))
    assert sorted(r.custom_id for r in requests.collect()) == sorted(f"item-{i * 7}" for i in range(5))
    body = json.dumps({"sentiment_score": 3.0, "tickers": ["a"], "themes": ["x"], "bull_signals": [], "bear_signals": ["b"]})
    landed = spark.createDataFrame([(f"item-{i * 7}", body if i else "garbage", None) for i in range(4)], schemas.RESPONSE)
    out = daily.daily_row(canonical, landed, F.lit("2024-01-01").cast("date")).first()
    assert out.item_count == 3 and out.consensus_score == 1.0 and out.confidence == "single-source" and out.tickers[0].mentions == 3
    _, dropped = daily.scored_records(canonical, landed)
    assert rows(dropped, "drop_reason") == [("missing",), ("unparseable",)]
    again, _ = daily.requests_for(spark.createDataFrame(raw, schemas.RAW_RECORD).repartition(3))
    assert rows(again, "idx", "title") == rows(canonical, "idx", "title")


def test_study_significance(spark):
    out = study.significance(spark, A.items_n(spark, SF), _prices(spark), iters=100).first()
    assert 0 < out.p <= 1 and out.ci_low <= out.ci_high


def _prices(spark):
    from opinara.sources.tables import price_series
    return price_series(A.bars(spark, SF, True))


# --- physical plans ------------------------------------------------------------------------------------
def test_rank_bounds_are_applied_before_the_shuffle(spark):
    items = A.items_e(spark, SF)
    for df in (pick_citations(items), first_wins(items, "subject")):
        text = plan_of(df)
        assert "WindowGroupLimit" in text and "Python" not in text and "CartesianProduct" not in text


def test_reading_scan_reads_two_columns_with_partial_aggregates(spark):
    text = plan_of(subject_reading(A.items_e(spark, SF)))
    assert "ReadSchema: struct<user_id:bigint,value:double>" in text and text.count("HashAggregate") >= 2 and "BatchEvalPython" not in text


def test_subject_filter_prunes_partitions(spark, tmp_path):
    spark.range(10).selectExpr("id", "concat('s', id % 2) subject").write.partitionBy("subject").parquet(f"{tmp_path}/t")
    text = plan_of(spark.read.parquet(f"{tmp_path}/t").filter("subject = 's1'"))
    assert "PartitionFilters: [isnotnull(subject" in text


def test_search_is_a_bounded_top_k(spark):
    text = plan_of(semantic_search(A.vectors(spark, SF), [0.1] * 64, 5))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_token_join_has_no_cross_product(spark):
    from opinara.operators.mentions import count_subjects
    dim = spark.createDataFrame([("S", "the", False)], "subject string, alias string, ambiguous boolean")
    docs = A.table(spark, SF, "documents")
    text = plan_of(count_subjects(docs, AliasSet(dim, 0)))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def _items(spark, rows_):
    df = spark.createDataFrame(rows_, "external_id string, subject string, score int, text string, ts timestamp, ingest_seq bigint")
    for f in schemas.ITEM.fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return embed.embed_hashed(df.drop("embedding").withColumn("source", F.lit("news:x")))


def test_readings_come_from_the_closest_items(spark):
    from opinara.plans import readings as V

    near = [(f"n{i}", "NVDA", 100, "Nvidia chips", T0, i) for i in range(40)]
    far = [(f"f{i}", "NVDA", -100, "gardening tips", T0, 100 + i) for i in range(60)]
    items = _items(spark, near + far)
    dim = spark.createDataFrame([("nvidia", "Nvidia chips", "stock", True, "NVDA"), ("empty", "Empty", "stock", True, "NONE"), ("hobby", "Hobby", None, False, None)],
                                "input_key string, display string, asset_type string, is_financial boolean, proxy string")
    requests = spark.createDataFrame([(" Nvidia ",), ("empty",), ("hobby",), ("who",)], "text string")
    now = F.lit(T0 + timedelta(days=3)).cast("timestamp")
    stored = spark.createDataFrame([], schemas.READING)
    prices = spark.createDataFrame([("NVDA", "2024-01", 10.0)], "symbol string, period string, close double")
    served, outside, unknown = V.answer(requests, dim, stored, items, prices, now, embed=embed.embed_hashed, k=40)
    got = {r.subject: r for r in served.collect()}
    assert (got["NVDA"].consensus_score, got["NVDA"].volume, got["NVDA"].cached) == (100.0, 40, False)
    assert len(got["NVDA"].citations) == 14 and got["NVDA"].display == "Nvidia chips"
    assert (got["NONE"].consensus_score, got["NONE"].volume, got["NONE"].label, got["NONE"].citations) == (0.0, 0, "neutral", [])
    assert got["NONE"].display == "Empty"
    assert outside.count() == 1 and [r.input_key for r in unknown.collect()] == ["who"]
    fresh = served.filter("volume > 0").drop("cached")
    again, _, _ = V.answer(requests, dim, fresh, items, prices, now, embed=embed.embed_hashed, k=40)
    assert {r.subject: r.cached for r in again.collect()} == {"NVDA": True, "NONE": False}
    forced, _, _ = V.answer(requests, dim, fresh, items, prices, now, embed=embed.embed_hashed, k=100, force_refresh=True)
    assert {r.subject: (r.volume, r.cached) for r in forced.collect()} == {"NVDA": (100, False), "NONE": (0, False)}


def test_thin_subjects_are_refilled_without_scoring_known_items(spark, tmp_path):
    from opinara.plans import readings as V

    store = OpinionStore(spark, str(tmp_path / "store"))
    store.append_items(_items(spark, [(f"a{i}", "RICH", 1, "t", T0, i) for i in range(30)] + [("b0", "THIN", 1, "t", T0, 0)]))
    subjects = spark.createDataFrame([("RICH", "Rich"), ("THIN", "Thin")], "subject string, display string")
    fetched = _items(spark, [("b0", "THIN", None, "known", T0, 1), ("b1", "THIN", None, "new", T0, 2), ("b1", "THIN", None, "twice", T0, 3),
                             (None, "THIN", None, "no key", T0, 4), ("a99", "RICH", None, "not asked", T0, 5)])

    def run(model):
        return V.refill(store, subjects, fetched, model, embed.embed_hashed)
    with pytest.raises(scoring.ScoringFailed):
        run(scorer("invalid key", "401"))
    assert store.items().count() == 31
    assert run(scorer(json.dumps({"relevant": True, "score": 7, "rationale": "r"}), None)) == 1
    assert rows(store.items("THIN"), "external_id", "score", "text") == [("b0", 1, "t"), ("b1", 7, "new")]
    assert V.refill(store, subjects, fetched, scorer(json.dumps({"relevant": True, "score": 7}), None), embed.embed_hashed, force=True) == 1


def test_daily_row_reads_its_items_once(spark, tmp_path):
    A.daily_e(spark, SF).write.parquet(str(tmp_path / "items"))
    from opinara.operators.daily import daily_consensus

    plan = plan_of(daily_consensus(spark.read.parquet(str(tmp_path / "items"))))
    assert plan.count("Location:") == 1


def test_a_hot_day_sends_ten_of_each_kind_per_task(spark, tmp_path):
    """A million-signal day must not meet in one task: the rank bound comes before the shuffle."""
    from opinara.operators.daily import daily_consensus

    day = A.daily_e(spark, SF).limit(1).drop("bull_signals", "ingest_seq")
    hot = spark.range(5000).crossJoin(day).withColumns({
        "ingest_seq": F.col("id"), "bull_signals": F.array(F.concat(F.lit("signal "), F.lit(5000) - F.col("id")), F.lit("Common"))})
    hot.drop("id").write.parquet(str(tmp_path / "hot"))
    out = daily_consensus(spark.read.parquet(str(tmp_path / "hot")))
    assert "WindowGroupLimit" in plan_of(out)
    assert out.first().bull_signals == ["signal 5000", "Common", *(f"signal {5000 - i}" for i in range(1, 9))][:len(out.first().bull_signals)]


def test_headline_test(spark):
    """A day's score meets the return to the next close; unanswered and unreadable headlines are left out."""
    days = [(f"2015-01-{d:02d}", "b'up'" if d % 2 else "b'down'", '"noise"' if d != 3 else None, "b'odd'") for d in range(1, 9)]
    found = headlines_long(spark.createDataFrame([*days, ("2014-12-31", "b'down'", None, None)], "Date string, Top1 string, Top2 string, Top3 string"), 2015)
    _, requests = headlines.headline_requests(found)
    assert requests.select("custom_id").distinct().count() == requests.count() == 23

    def answers(score):
        return json.dumps({"sentiment_score": score, "tickers": [], "themes": [], "bull_signals": [], "bear_signals": []})
    title = F.regexp_extract("content", "TITLE: (.*)", 1)
    responses = requests.filter(title != "noise").select(
        "custom_id", F.when(title == "up", answers(0.8)).when(title == "down", answers(-0.8)).otherwise("none").alias("body"),
        F.lit(None).cast("string").alias("error_class"))
    assert {r.run_date: r.score for r in headlines.daily_scores(found, responses).collect()} == {
        f"2015-01-{d:02d}": 0.8 if d % 2 else -0.8 for d in range(1, 9)}
    closes = [("X", f"2015-01-{d:02d}", 100.0 if d % 2 else 110.0) for d in range(1, 10)]
    closes += [("Y", "2015-01-01", 100.0), ("Y", "2015-01-02", None), ("Y", "2015-01-03", 90.0), ("Y", "2015-01-05", 99.0), ("Z", "2015-01-01", 5.0)]
    got = {r.symbol: r for r in headlines.headline_test(found, responses, spark.createDataFrame(closes, "symbol string, run_date string, close double")).collect()}
    assert set(got) == {"X", "Y"}  # one close alone has no return
    assert (got["X"].n, got["X"].calls, got["X"].hit_rate, got["X"].up_rate, got["X"].verdict) == (8, 8, 1.0, 0.5, "too few calls")
    assert got["X"].strategy_return == pytest.approx(1.1**4 - 1)
    assert (got["Y"].n, got["Y"].hit_rate) == (2, 0.5)
    with pytest.raises(scoring.ScoringFailed):
        headlines.daily_scores(found, responses.withColumn("error_class", F.lit("RateLimitError")))
