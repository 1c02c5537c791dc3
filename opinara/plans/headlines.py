"""The historical test: does the mood of a day's headlines tell the next trading day's return?"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from opinara.operators.daily import headline, weighted
from opinara.operators.scoring import require_working_scorer, sentiment_requests
from opinara.operators.study import next_period_return, signal_evaluation, signal_verdict
from opinara.plans.daily import numbered, scored_records
from opinara.sources.tables import headline_records


def headline_requests(headlines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered records of ``headlines_long`` and the requests to send to the scorer.

    A number is made of the day and the position in it, so a later evaluation meets the same responses.
    """
    seq = F.shiftleft(F.unix_date(F.to_date("run_date")).cast("bigint"), 16) + F.col("position")
    canonical = numbered(headline_records(headlines).withColumn("ingest_seq", seq))
    return canonical, sentiment_requests(canonical)


def daily_scores(headlines: DataFrame, responses: DataFrame) -> DataFrame:
    """``(run_date, score)``: the consensus of every day as it stood at the end of that day.

    Headlines without a readable response are left out; a broken scorer raises.
    """
    require_working_scorer(responses, "historical test")
    scored, _ = scored_records(headline_requests(headlines)[0], responses)
    end = F.to_timestamp(F.concat("run_date", F.lit(" 23:59:59")))
    return headline(weighted(scored, end)).select("run_date", F.col("consensus_score").alias("score"))


def headline_test(headlines: DataFrame, responses: DataFrame, closes: DataFrame) -> DataFrame:
    """One row per symbol of ``closes(symbol, run_date, close)``: evaluation of the daily scores, and the verdict.

    Returns run from a trading day to the next one that has a close; days without score or
    return take no part, and a symbol needs two.
    """
    returns = next_period_return(closes.filter("close is not null"), order="run_date").select("symbol", "run_date", "ret")
    return signal_verdict(signal_evaluation(daily_scores(headlines, responses), returns, ["run_date"], ["symbol"]))
