"""Scalar expressions: periods, weights, labels, keys.  All JVM built-ins."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

from opinara import config


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body refers to it.

    Inside one row a common sub-expression of lambdas is otherwise evaluated per use.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --- time ----------------------------------------------------------------------
def bucket_key(ts: Column | str, period: str) -> Column:
    """Month ``yyyy-MM`` or the Monday date of the week, as text."""
    if period == "month":
        return F.date_format(_col(ts), "yyyy-MM")
    if period == "week":
        return F.date_format(F.date_trunc("week", _col(ts)), "yyyy-MM-dd")
    raise ValueError(f"unknown period: {period}")


def bucket_start(ts: Column | str, period: str) -> Column:
    """First instant of the month or week: the key to group by; format it after grouping."""
    if period not in ("month", "week"):
        raise ValueError(f"unknown period: {period}")
    return F.date_trunc(period, _col(ts))


def period_calendar(spark: SparkSession, now: str, period: str, n: int):
    """The last ``n`` periods, newest first: ``label, start_unix, end_unix``."""
    if period not in ("month", "week"):
        raise ValueError(f"unknown period: {period}")
    base = F.date_trunc(period, F.to_timestamp(F.lit(now)))
    months = F.lit(0) if period == "week" else -F.col("back")
    weeks = F.lit(0) if period == "month" else -F.col("back")
    start = base + F.make_interval(months=months, weeks=weeks)
    span = F.expr("interval 1 month") if period == "month" else F.expr("interval 7 days")
    return (spark.range(n).select(F.col("id").cast("int").alias("back"))
            .withColumn("start", start)
            .select("back", bucket_key("start", period).alias("label"),
                    F.unix_timestamp("start").alias("start_unix"),
                    (F.unix_timestamp(F.col("start") + span) - 1).alias("end_unix"))
            .orderBy("back"))


def to_utc(value: Column | str) -> Column:
    """Epoch seconds, or a timestamp without zone read as UTC, to a timestamp."""
    return F.timestamp_seconds(_col(value).cast("double"))


def feed_date(text: Column | str) -> Column:
    """Feed dates: RFC-822 (weekday optional, numeric or GMT zone) or ISO-8601."""
    raw = F.trim(_col(text))
    no_weekday = F.regexp_replace(raw, r"^[A-Za-z]{3},\s*", "")
    numeric = F.regexp_replace(no_weekday, r"\s(?:GMT|UTC|UT|Z)$", " +0000")
    padded = F.regexp_replace(numeric, r"^(\d)\s", "0$1 ")
    return F.coalesce(F.try_to_timestamp(padded, F.lit("dd MMM yyyy HH:mm:ss Z")),
                      F.try_to_timestamp(padded, F.lit("dd MMM yyyy HH:mm Z")),
                      F.try_to_timestamp(raw))


def utc_day_start(ts: Column | str) -> Column:
    return F.date_trunc("day", _col(ts))


def age_hours(ts: Column | str, now: Column) -> Column:
    """Fractional hours from ``ts`` to ``now``; null when ``ts`` is null."""
    return (F.unix_micros(now) - F.unix_micros(_col(ts))) / F.lit(3_600_000_000.0)


# --- weights ---------------------------------------------------------------------
def tier_for_source(source: Column | str) -> Column:
    branch = None
    for prefix, tier in config.SOURCE_TIERS:
        hit = _col(source).startswith(prefix)
        branch = F.when(hit, F.lit(tier)) if branch is None else branch.when(hit, F.lit(tier))
    return branch.otherwise(F.lit(config.DEFAULT_TIER))


def tier_weight(tier: Column | str) -> Column:
    branch = None
    for value, weight in config.SOURCE_WEIGHTS.items():
        hit = _col(tier) == value
        branch = F.when(hit, F.lit(weight)) if branch is None else branch.when(hit, F.lit(weight))
    return branch.otherwise(F.lit(0.0))


def is_directional(tier: Column | str) -> Column:
    return tier_weight(tier) > 0


def recency_factor(ts: Column | str, now: Column) -> Column:
    """Half-life decay; a missing or future timestamp has age 0."""
    age = F.greatest(F.lit(0.0), F.coalesce(age_hours(ts, now), F.lit(0.0)))
    return F.pow(F.lit(0.5), age / F.lit(config.RECENCY_HALF_LIFE_HOURS))


def engagement_factor(engagement: Column | str) -> Column:
    safe = F.greatest(F.lit(0), F.coalesce(_col(engagement), F.lit(0)))
    return F.lit(1.0) + F.lit(config.ENGAGEMENT_LOG_WEIGHT) * F.log1p(safe.cast("double"))


def item_weight(tier: Column | str, ts: Column | str, engagement: Column | str, now: Column) -> Column:
    return tier_weight(tier) * recency_factor(ts, now) * engagement_factor(engagement)


def weighted_mean(weight: Column, value: Column) -> Column:
    """Aggregate expression: sum(w*v)/sum(w), 0 without weight."""
    return F.coalesce(F.try_divide(F.sum(weight * value), F.sum(weight)), F.lit(0.0))


# --- labels ---------------------------------------------------------------------------
def _band_label(score: Column, band: float) -> Column:
    return (F.when(score > band, "bullish").when(score < -band, "bearish").otherwise("neutral"))


def daily_label(score: Column | str) -> Column:
    return _band_label(_col(score), config.DAILY_NEUTRAL_BAND)


def reading_label(score: Column | str) -> Column:
    """Label of a reading; give it the rounded score."""
    return _band_label(_col(score), config.READING_NEUTRAL_BAND)


def spread_confidence(spread: Column | str) -> Column:
    return (F.when(_col(spread) <= config.CONFIDENCE_HIGH_MAX, "high")
            .when(_col(spread) <= config.CONFIDENCE_MEDIUM_MAX, "medium").otherwise("low"))


def agreement_note(dispersion: Column | str) -> Column:
    return F.when(F.coalesce(_col(dispersion), F.lit(0.0)) > config.SPLIT_DISPERSION,
                  "split").otherwise("aligned")


# --- keys and numbers -----------------------------------------------------------------------
def clamp(x: Column | str, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), _col(x)))


def subject_key(proxy: Column | str, display: Column | str) -> Column:
    return F.upper(F.coalesce(F.nullif(_col(proxy), F.lit("")), _col(display)))


def resolver_key(text: Column | str) -> Column:
    """What the user typed, as the lookup key of the subject dimension."""
    from opinara.functions.text import strip

    return F.lower(strip(_col(text)))


def client_key(forwarded: Column | str, peer: Column | str) -> Column:
    """First forwarded address, else the socket peer, else ``unknown``."""
    from opinara.functions.text import strip

    first = strip(F.split(_col(forwarded), ",", 2)[0])
    return F.coalesce(F.nullif(first, F.lit("")), _col(peer), F.lit("unknown"))
