from __future__ import annotations

import math
import random
import statistics
from datetime import datetime, timedelta, timezone

from conftest import rows
from pyspark.sql import functions as F

from opinara import config
from opinara.operators import daily as D
from opinara.operators import readings as R

ITEM = "external_id string, subject string, score int, similarity double, source string, url string, text string, ts timestamp"
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def items(spark, scores, subject="S"):
    data = [(f"i{k:03d}", subject, s, 1.0 - k / 1000, "src", None, f"text {k}", T0 + timedelta(days=k)) for k, s in enumerate(scores)]
    return spark.createDataFrame(data, ITEM)


def brute_pick(scores, n):
    ranked = list(enumerate(scores))
    bulls = sorted((i for i in ranked if i[1] > 0), key=lambda i: -i[1])[:n // 2]
    bears = sorted((i for i in ranked if i[1] < 0), key=lambda i: i[1])[:n - n // 2]
    picked = bulls + bears
    picked += [i for i in ranked if i not in picked][:max(0, n - len(picked))]
    return [f"i{k:03d}" for k, _ in picked[:n]]


def test_citations_against_brute_force(spark):
    rng = random.Random(9)
    cases = {"mixed": [rng.randint(-100, 100) for _ in range(80)], "bulls": [rng.randint(1, 9) for _ in range(40)], "few": [5, -5, 0],
             "neutral": [0] * 30, "bears": [-1] * 20, "one": [7], "ties": [rng.choice([-3, 3]) for _ in range(50)]}
    frame = None
    for name, scores in cases.items():
        part = items(spark, scores, name)
        frame = part if frame is None else frame.unionByName(part)
    for n in (14, 5):
        got = {}
        for r in R.pick_citations(frame, n).orderBy("subject", "n").collect():
            got.setdefault(r.subject, []).append(r.external_id)
        assert got == {name: brute_pick(scores, n) for name, scores in cases.items()}


def test_reading_of_one_item_and_of_none(spark):
    out = R.subject_reading(items(spark, [40])).first()
    assert (out.consensus_score, out.conviction, out.dispersion, out.volume, out.label) == (40.0, 40.0, 0.0, 1, "bullish")
    asked = spark.createDataFrame([("S",), ("nobody",)], "subject string")
    empty = R.reading_or_empty(asked, R.subject_reading(items(spark, [40]))).filter("subject = 'nobody'").first()
    assert (empty.consensus_score, empty.volume, empty.label) == (0.0, 0, "neutral")


def test_label_uses_the_rounded_score(spark):
    scores = [15] * 96 + [16] * 4          # mean 15.04 rounds to 15.0: still neutral
    assert R.subject_reading(items(spark, scores)).first().label == "neutral"


def test_reading_against_statistics(spark):
    rng = random.Random(1)
    scores = [rng.randint(-100, 100) for _ in range(333)]
    out = R.subject_reading(items(spark, scores)).first()
    assert out.consensus_score == round(sum(scores) / len(scores), 1)
    assert out.conviction == round(sum(map(abs, scores)) / len(scores), 1)
    assert out.dispersion == round(statistics.pstdev(scores), 1)


def test_period_readings_skip_undated_and_thin(spark):
    frame = items(spark, [10, 20, 30]).withColumn("ts", F.when(F.col("external_id") != "i002", F.col("ts")))
    assert rows(R.period_readings(frame, "month"), "period", "consensus", "n") == [("2024-01", 15.0, 2)]
    assert R.period_readings(frame, "month", 3).count() == 0


def test_staleness_of_an_unusable_time(spark):
    frame = spark.createDataFrame([("a", None), ("b", T0), ("c", T0 + timedelta(days=9))], "subject string, computed_at timestamp")
    out = R.stale_readings(frame, F.to_timestamp(F.lit("2024-01-10 12:00:00"))).collect()
    assert [(r.subject, r.age_h) for r in out] == [("a", math.inf), ("b", 228.0)]


def test_deltas_and_scaling(spark):
    frame = spark.createDataFrame([("S", "2024-01", None, 10.0), ("S", "2024-02", 5.0, None), ("S", "2024-03", 9.0, 15.0), ("F", "2024-01", 3.0, None)],
                                  "subject string, period string, conviction double, price double")
    assert rows(R.series_deltas(frame)) == [("F", None, None), ("S", 4.0, 0.5)]
    pos = {(r.subject, r.period): r.conviction_pos for r in R.scale_series(frame, "conviction").collect()}
    assert abs(pos[("F", "2024-01")] - 0.5) < 1e-12 and pos[("S", "2024-01")] is None
    assert abs(pos[("S", "2024-02")] - 0.12 / 1.24) < 1e-12


# --- daily ------------------------------------------------------------------------------------
SCORED = ("run_date date, ingest_seq bigint, source_tier int, ts timestamp, raw_engagement bigint, sentiment_score double, "
          "tickers array<string>, themes array<string>, bull_signals array<string>, bear_signals array<string>")


def brute_daily(records, now):
    def weight(r):
        age = 0.0 if r[3] is None else max(0.0, (now - r[3]).total_seconds() / 3600)
        return config.SOURCE_WEIGHTS.get(r[2], 0.0) * 0.5 ** (age / 12) * (1 + 0.15 * math.log1p(max(0, r[4])))

    def mean(rs):
        total = sum(map(weight, rs))
        return sum(weight(r) * r[5] for r in rs) / total if total else 0.0
    tiers = {t: mean([r for r in records if r[2] == t]) for t in sorted({r[2] for r in records}) if config.SOURCE_WEIGHTS.get(t, 0.0) > 0}
    spread = statistics.pstdev(tiers.values()) if len(tiers) > 1 else 0.0
    themes, shown = {}, {}
    for r in records:
        for theme in r[7]:
            key = theme.strip().lower()
            if key:
                themes[key] = themes.get(key, 0) + 1
                shown.setdefault(key, theme.strip())
    top = sorted(themes.items(), key=lambda kv: -kv[1])[:10]
    signals = []
    for r in records:
        for s in r[8]:
            if s.strip() and s.strip().lower() not in [x.lower() for x in signals]:
                signals.append(s.strip())
    mentions = {}
    for r in records:
        if config.SOURCE_WEIGHTS.get(r[2], 0.0) > 0:
            for t in r[6]:
                if t.strip():
                    mentions.setdefault(t.strip().upper(), []).append(r)
    tickers = [(t, round(mean(rs), 4), len(rs)) for t, rs in mentions.items() if len(rs) >= 2]
    tickers.sort(key=lambda t: -abs(t[1]))
    return (round(mean(records), 4), {t: round(v, 4) for t, v in tiers.items()}, round(spread, 4), sum(weight(r) > 0 for r in records),
            [(shown[k], c) for k, c in top], signals[:10], tickers)


def test_daily_against_brute_force(spark):
    rng = random.Random(8)
    day = T0.date()
    records = []
    for i in range(60):
        ts = None if i % 11 == 0 else T0 + timedelta(hours=rng.uniform(0, 30))
        records.append((day, i, rng.choice([1, 2, 3, 9]), ts, rng.choice([-5, 0, 3, 5000]), rng.uniform(-1, 1),
                        [rng.choice(["nvda", " NVDA ", "amd", "", "tsm"]) for _ in range(rng.randint(0, 3))],
                        [rng.choice(["AI", "ai ", "Chips", "rates", " "]) for _ in range(2)], [f" Signal {rng.randint(0, 14)} ", "signal 3"], []))
    now = T0 + timedelta(hours=23, minutes=59, seconds=59)
    out = D.daily_consensus(spark.createDataFrame(records, SCORED)).first()
    got = (out.consensus_score, dict(out.tier_means), out.dispersion, out.contributing_count, [tuple(t) for t in out.top_themes],
           list(out.bull_signals), [(t.ticker, t.score, t.mentions) for t in out.tickers])
    assert got == brute_daily(records, now)
    assert out.item_count == 60 and out.bear_signals == [] and out.contested == (out.dispersion > 0.4)


def test_confidence_needs_two_directional_tiers(spark):
    def confidence(*tiers):
        rs = [(T0.date(), i, t, T0, 0, 0.5, [], [], [], []) for i, t in enumerate(tiers)]
        return D.daily_consensus(spark.createDataFrame(rs, SCORED)).first().confidence
    assert confidence(2, 3) == "high" and confidence(2, 1) == "single-source" and confidence(1) == "none"


def test_order_of_lists_holds_for_large_numbers(spark):
    """Item numbers above 2^47 and of far apart files keep their order."""
    from opinara.operators.daily import distinct_signals

    rows_ = [(2**62 + 5, ["late", "Early"]), (2**48 + 1, ["early", "mid"]), (3, ["first"])]
    df = spark.createDataFrame(rows_, "ingest_seq bigint, bull_signals array<string>").withColumn("run_date", F.lit("2024-01-01").cast("date"))
    got = [r.signal for r in distinct_signals(df, "bull_signals").orderBy("rank").collect()]
    assert got == ["first", "early", "mid", "late"]
