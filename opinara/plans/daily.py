"""From landed records to the daily consensus row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from opinara.operators.daily import daily_consensus
from opinara.operators.records import normalize
from opinara.operators.scoring import custom_id, parse_sentiment, require_working_scorer, sentiment_requests


def numbered(canonical: DataFrame) -> DataFrame:
    """Records with their request number.

    That is ``ingest_seq``, which ``sources.feeds`` derives from file and position: evaluating
    the plan again, or with another partitioning, gives every record its number again.
    """
    return canonical.withColumn("idx", F.col("ingest_seq"))


def scored_records(canonical: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered records with their sentiment, and the ones dropped for want of it."""
    parsed = parse_sentiment(responses).withColumn("_known", F.lit(True))
    joined = canonical.withColumn("custom_id", custom_id("idx")).join(parsed, "custom_id", "left")
    reason = F.when(F.col("_known").isNull(), "missing").otherwise(F.col("drop_reason"))
    judged = joined.withColumn("drop_reason", reason).drop("_known", "body", "error_class")
    return (judged.filter("drop_reason is null").drop("drop_reason"),
            judged.filter("drop_reason is not null").select("custom_id", "source", "title", "drop_reason"))


def requests_for(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical numbered records and the requests to send to the scorer."""
    canonical = numbered(normalize(raw))
    return canonical, sentiment_requests(canonical)


def daily_row(canonical: DataFrame, responses: DataFrame, run_date: Column, now: Column | None = None) -> DataFrame:
    """Checks the scorer, aligns its responses and aggregates; a broken scorer raises."""
    require_working_scorer(responses, "daily consensus")
    scored, _ = scored_records(canonical, responses)
    return daily_consensus(scored.withColumn("run_date", run_date), now)
