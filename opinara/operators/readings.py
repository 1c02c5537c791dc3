"""Subject readings: consensus numbers, periods, citations, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from opinara import config
from opinara.functions.rounding import py_round
from opinara.functions.scalars import age_hours, bucket_key, bucket_start, reading_label
from opinara.operators.records import citation_struct


# --- headline numbers -----------------------------------------------------------------------
def subject_reading(items: DataFrame, by: list[str] | str = "subject") -> DataFrame:
    """Mean stance, mean strength, spread and volume per group, one decimal, with label.

    A single hash aggregate with map-side partials: a dominating subject costs one partial
    row per input partition.
    """
    by = [by] if isinstance(by, str) else list(by)
    score = F.col("score").cast("bigint")
    raw = (items.filter(F.col("score").isNotNull()).groupBy(*by)
           .agg(F.avg(score).alias("_mean"), F.avg(F.abs(score)).alias("_strength"),
                F.stddev_pop(score).alias("_spread"), F.count(score).alias("volume")))
    return (raw.select(*by, py_round("_mean", 1).alias("consensus_score"),
                       py_round("_strength", 1).alias("conviction"),
                       py_round("_spread", 1).alias("dispersion"), "volume")
            .withColumn("label", reading_label("consensus_score")))


def reading_or_empty(subjects: DataFrame, readings: DataFrame) -> DataFrame:
    """Readings for every asked subject; all zero where there are no items."""
    zero = {"consensus_score": 0.0, "conviction": 0.0, "dispersion": 0.0, "volume": 0, "label": "neutral"}
    return subjects.join(readings, "subject", "left").fillna(zero)


def period_readings(items: DataFrame, period: str = "month", min_items: int = 1,
                    by: list[str] | str = "subject") -> DataFrame:
    """Mean stance per group and month or week; thin buckets and undated items are dropped."""
    by = [by] if isinstance(by, str) else list(by)
    raw = (items.filter(F.col("ts").isNotNull() & F.col("score").isNotNull())
           .groupBy(*by, bucket_start("ts", period).alias("_start"))
           .agg(F.avg(F.col("score").cast("bigint")).alias("_mean"), F.count(F.lit(1)).alias("n")))
    return (raw.filter(F.col("n") >= min_items)
            .select(*by, bucket_key("_start", period).alias("period"), py_round("_mean", 1).alias("consensus"), "n"))


# --- citations ---------------------------------------------------------------------------------
def pick_citations(items: DataFrame, n: int = config.CITATIONS, by: str = "subject",
                   item_id: str = "external_id", relevance: str = "similarity") -> DataFrame:
    """A balanced, numbered pick per subject.

    The strongest bulls, then the strongest bears, then the most relevant rest.  Every item
    is ranked in up to three lanes with one window over ``(subject, lane)``.  Only the first
    2n ranks of a lane can matter, and that bound is planned as a group limit before the
    shuffle: a hot subject ships at most 6n rows per input partition.
    """
    bulls, bears = n // 2, n - n // 2
    score = F.col("score")
    lanes = F.filter(F.array(
        F.when(score > 0, F.struct(F.lit(0).alias("lane"), (-score).cast("int").alias("key"))),
        F.when(score < 0, F.struct(F.lit(1).alias("lane"), score.cast("int").alias("key"))),
        F.struct(F.lit(2).alias("lane"), F.lit(0).alias("key"))), lambda s: s.isNotNull())
    ranked = items.filter(score.isNotNull()).withColumn("_l", F.explode(lanes))
    in_lane = Window.partitionBy(by, "_l.lane").orderBy("_l.key", F.desc(relevance), item_id)
    short = ranked.withColumn("_rank", F.row_number().over(in_lane)).filter(F.col("_rank") <= 2 * n)
    lane_cap = F.when(F.col("_l.lane") == 0, bulls).when(F.col("_l.lane") == 1, bears).otherwise(2 * n)
    short = short.filter(F.col("_rank") <= lane_cap)
    # An item picked as bull or bear may not come back as filler.
    once = Window.partitionBy(by, item_id).orderBy("_l.lane")
    short = short.withColumn("_once", F.row_number().over(once)).filter("_once = 1")
    final = Window.partitionBy(by).orderBy("_l.lane", "_rank")
    return (short.withColumn("n", F.row_number().over(final)).filter(F.col("n") <= n)
            .drop("_l", "_rank", "_once"))


def citation_arrays(picked: DataFrame, by: str = "subject") -> DataFrame:
    """The numbered picks of a subject as one ordered array; its length is bounded by n."""
    return picked.groupBy(by).agg(F.array_sort(F.collect_list(citation_struct())).alias("citations"))


# --- latest, history, staleness -------------------------------------------------------------------
def latest_reading(readings: DataFrame, by: str = "subject") -> DataFrame:
    """The newest reading per subject, as a whole row."""
    newest = Window.partitionBy(by).orderBy(F.desc("computed_at"))
    return readings.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn")


def latest_instant(readings: DataFrame, by: str = "subject") -> DataFrame:
    return readings.groupBy(by).agg(F.max("computed_at").alias("computed_at"))


def reading_history(readings: DataFrame, limit: int = config.HISTORY_LIMIT, by: str = "subject") -> DataFrame:
    """The first ``limit`` readings of a subject, oldest first (``position`` from 1)."""
    oldest = Window.partitionBy(by).orderBy("computed_at")
    return (readings.withColumn("position", F.row_number().over(oldest))
            .filter(F.col("position") <= limit))


def latest_days(daily: DataFrame, limit: int = 30) -> DataFrame:
    return daily.orderBy(F.desc("run_date")).limit(limit)


def recent_history(daily: DataFrame, days: int = 30) -> DataFrame:
    """The most recent ``days`` rows in time order."""
    return latest_days(daily, days).orderBy("run_date")


def day_row(daily: DataFrame, run_date: str) -> DataFrame:
    return daily.filter(F.col("run_date") == F.lit(run_date).cast("date"))


def stale_readings(readings: DataFrame, now: Column, max_age_hours: float = config.READING_MAX_AGE_HOURS,
                   cap: int | None = config.STALE_REFRESH_CAP) -> DataFrame:
    """Subjects whose newest reading is older than the time to live, stalest first.

    A reading without a usable time is infinitely old.
    """
    age = F.coalesce(age_hours("computed_at", now), F.lit(float("inf")))
    out = (latest_instant(readings).withColumn("age_h", age)
           .filter(F.col("age_h") > max_age_hours).orderBy(F.desc("age_h"), "subject"))
    return out if cap is None else out.limit(cap)


def readings_since(readings: DataFrame, since: Column) -> DataFrame:
    return readings.filter(F.col("computed_at") >= since).agg(F.count(F.lit(1)).alias("n"))


def corpus_size(items: DataFrame) -> DataFrame:
    return items.agg(F.count(F.lit(1)).alias("items"))


def items_per_subject(subjects: DataFrame, items: DataFrame) -> DataFrame:
    """Item count for each asked subject, zero when there are none."""
    counts = items.groupBy("subject").agg(F.count(F.lit(1)).alias("n_items"))
    return subjects.join(counts, "subject", "left").fillna(0, ["n_items"])


def ledger_stats(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("status").agg(
        F.count(F.lit(1)).alias("episodes"),
        F.coalesce(F.sum("n_items"), F.lit(0)).cast("bigint").alias("items"))


def counts_by(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *cols)


# --- measures of the reading page --------------------------------------------------------------------
def series_deltas(series: DataFrame, by: str = "subject") -> DataFrame:
    """Change of conviction, and relative change of price, from first to last known value.

    Null unless a series has two values.
    """
    def ends(value: str) -> tuple[Column, Column, Column]:
        known = F.when(F.col(value).isNotNull(), F.col("period"))
        return F.min_by(value, known), F.max_by(value, known), F.count(value)
    c0, c1, cn = ends("conviction")
    p0, p1, pn = ends("price")
    agg = series.groupBy(by).agg(c0.alias("_c0"), c1.alias("_c1"), cn.alias("_cn"),
                                 p0.alias("_p0"), p1.alias("_p1"), pn.alias("_pn"))
    return agg.select(
        by, F.when(F.col("_cn") > 1, F.col("_c1") - F.col("_c0")).alias("conviction_change"),
        F.when(F.col("_pn") > 1, F.try_divide(F.col("_p1") - F.col("_p0"), F.col("_p0"))).alias("price_change"))


def scale_series(series: DataFrame, value: str, by: str = "subject", pad: float = 0.12) -> DataFrame:
    """Position 0..1 of each value on a padded min-max axis; a flat series gets a range of +-1."""
    known = F.when(F.col(value).isNotNull() & ~F.isnan(value), F.col(value))
    bounds = series.groupBy(by).agg(F.min(known).alias("_lo"), F.max(known).alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    lo = F.when(flat, F.col("_lo") - 1).otherwise(F.col("_lo"))
    hi = F.when(flat, F.col("_hi") + 1).otherwise(F.col("_hi"))
    margin = (F.col("_b_hi") - F.col("_b_lo")) * pad
    return (series.join(bounds.select(by, lo.alias("_b_lo"), hi.alias("_b_hi")), by)
            .withColumn(f"{value}_pos", F.when(
                F.col(value).isNotNull(),
                (F.col(value) - (F.col("_b_lo") - margin)) / ((F.col("_b_hi") + margin) - (F.col("_b_lo") - margin))))
            .drop("_b_lo", "_b_hi"))


def reading_trend(readings: DataFrame, by: str = "subject") -> DataFrame:
    """Dated consensus points with their position, and whether the subject has enough for a line."""
    points = readings.filter(F.col("consensus_score").isNotNull() & F.col("computed_at").isNotNull())
    counts = points.groupBy(by).agg((F.count(F.lit(1)) >= 2).alias("drawable"))
    order = Window.partitionBy(by).orderBy("computed_at")
    return (points.select(by, "computed_at", "consensus_score")
            .withColumn("position", F.row_number().over(order)).join(counts, by))
