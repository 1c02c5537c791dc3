"""The scalar rules as SQL functions of a session, for users who write SQL.

They are SQL expressions that the optimizer inlines; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from opinara import config


def _tier_case(column: str) -> str:
    whens = " ".join(f"WHEN startswith({column}, '{prefix}') THEN {tier}" for prefix, tier in config.SOURCE_TIERS)
    return f"CASE {whens} ELSE {config.DEFAULT_TIER} END"


def _weight_case(column: str) -> str:
    whens = " ".join(f"WHEN {column} = {tier} THEN {weight}D" for tier, weight in config.SOURCE_WEIGHTS.items())
    return f"CASE {whens} ELSE 0D END"


def definitions() -> dict[str, str]:
    """Name and signature to body."""
    return {
        "source_tier(source STRING) RETURNS INT": _tier_case("source"),
        "tier_weight(tier INT) RETURNS DOUBLE": _weight_case("tier"),
        "recency_factor(ts TIMESTAMP, now TIMESTAMP) RETURNS DOUBLE":
            "pow(0.5D, greatest(0D, coalesce((unix_micros(now) - unix_micros(ts)) / 3600000000D, 0D)) "
            f"/ {config.RECENCY_HALF_LIFE_HOURS}D)",
        "engagement_factor(engagement BIGINT) RETURNS DOUBLE":
            f"1D + {config.ENGAGEMENT_LOG_WEIGHT}D * log1p(CAST(greatest(0, coalesce(engagement, 0)) AS DOUBLE))",
        "daily_label(score DOUBLE) RETURNS STRING":
            f"CASE WHEN score > {config.DAILY_NEUTRAL_BAND} THEN 'bullish' "
            f"WHEN score < -{config.DAILY_NEUTRAL_BAND} THEN 'bearish' ELSE 'neutral' END",
        "reading_label(score DOUBLE) RETURNS STRING":
            f"CASE WHEN score > {config.READING_NEUTRAL_BAND} THEN 'bullish' "
            f"WHEN score < -{config.READING_NEUTRAL_BAND} THEN 'bearish' ELSE 'neutral' END",
        "subject_key(proxy STRING, display STRING) RETURNS STRING": "upper(coalesce(nullif(proxy, ''), display))",
        "month_key(ts TIMESTAMP) RETURNS STRING": "date_format(ts, 'yyyy-MM')",
        "week_key(ts TIMESTAMP) RETURNS STRING": "date_format(date_trunc('week', ts), 'yyyy-MM-dd')",
    }


def register(spark: SparkSession) -> None:
    for signature, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
