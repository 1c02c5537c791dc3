"""The weighted daily consensus with conflict detection.

Input: canonical records plus ``run_date, sentiment_score, tickers, themes, bull_signals,
bear_signals``.  ``now`` is the instant that item age is measured from, usually the end of the
day the row belongs to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from opinara import config
from opinara.functions.rounding import py_round
from opinara.functions.scalars import (daily_label, is_directional, item_weight, spread_confidence,
                                       weighted_mean)
from opinara.functions.text import strip


def end_of_day(run_date: Column | str = "run_date") -> Column:
    day = F.col(run_date) if isinstance(run_date, str) else run_date
    return F.to_timestamp(F.concat(day.cast("string"), F.lit(" 23:59:59")))


def weighted(scored: DataFrame, now: Column | None = None) -> DataFrame:
    """Adds ``weight`` = tier weight x recency x engagement."""
    now = end_of_day() if now is None else now
    return scored.withColumn("weight", item_weight("source_tier", "ts", "raw_engagement", now))


def weighted_consensus(weighted_items: DataFrame, by: str = "run_date") -> DataFrame:
    """Weighted mean per group, unrounded; 0 when nothing carries weight."""
    return weighted_items.groupBy(by).agg(
        weighted_mean(F.col("weight"), F.col("sentiment_score")).alias("weighted_mean"))


def tier_sums(weighted_items: DataFrame) -> DataFrame:
    """Per day and tier sums that the whole headline block is made of."""
    return weighted_items.groupBy("run_date", "source_tier").agg(
        F.sum("weight").alias("_w"), F.sum(F.col("weight") * F.col("sentiment_score")).alias("_wv"),
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("weight") > 0).alias("_contributing"))


def tier_means(weighted_items: DataFrame) -> DataFrame:
    """Weighted mean per day and directional tier, unrounded."""
    return (tier_sums(weighted_items).filter(is_directional("source_tier"))
            .select("run_date", "source_tier",
                    F.coalesce(F.try_divide("_wv", "_w"), F.lit(0.0)).alias("tier_mean")))


def headline(weighted_items: DataFrame) -> DataFrame:
    """Consensus, counts, tier means, dispersion, contested flag and confidence per day.

    Items are read once: one aggregate on (day, tier), and a second one over at most a handful
    of tier rows per day.
    """
    mean = F.coalesce(F.try_divide("_wv", "_w"), F.lit(0.0))
    directional = is_directional("source_tier")
    days = (tier_sums(weighted_items).withColumn("_mean", F.when(directional, mean))
            .groupBy("run_date").agg(
                F.coalesce(F.try_divide(F.sum("_wv"), F.sum("_w")), F.lit(0.0)).alias("_consensus"),
                F.sum("_n").alias("item_count"), F.sum("_contributing").alias("contributing_count"),
                F.coalesce(F.stddev_pop("_mean"), F.lit(0.0)).alias("_dispersion"),
                F.count("_mean").alias("_tiers"),
                F.map_from_entries(F.array_sort(F.collect_list(F.when(
                    directional, F.struct(F.col("source_tier"), py_round(mean, 4)))))).alias("tier_means")))
    return days.select("run_date", *_headline_columns())


def _headline_columns() -> list[Column | str]:
    return [
        py_round("_consensus", 4).alias("consensus_score"), daily_label("_consensus").alias("label"),
        (F.when(F.col("_tiers") >= 2, spread_confidence("_dispersion"))
         .when(F.col("_tiers") == 1, "single-source").otherwise("none")).alias("confidence"),
        (F.col("_dispersion") > config.CONFLICT_STDDEV).alias("contested"),
        py_round("_dispersion", 4).alias("dispersion"), "item_count", "contributing_count", "tier_means"]


# --- lists ------------------------------------------------------------------------------------
def _encounter() -> Column:
    """Item order, then list position."""
    return F.struct("ingest_seq", "_pos")


def ticker_consensus(weighted_items: DataFrame) -> DataFrame:
    """Per day and ticker, from directional items: score, label, mentions, confidence, rank."""
    mentions = (weighted_items.filter(is_directional("source_tier"))
                .select("run_date", "ingest_seq", "weight", "sentiment_score",
                        F.posexplode("tickers").alias("_pos", "_t"))
                .withColumn("ticker", F.upper(strip("_t"))).filter("ticker != ''"))
    raw = mentions.groupBy("run_date", "ticker").agg(
        weighted_mean(F.col("weight"), F.col("sentiment_score")).alias("_score"),
        F.count(F.lit(1)).alias("mentions"), F.stddev_pop("sentiment_score").alias("_spread"),
        F.min(_encounter()).alias("_first"))
    kept = raw.filter(F.col("mentions") >= config.MIN_TICKER_MENTIONS).select(
        "run_date", "ticker", py_round("_score", 4).alias("score"), daily_label("_score").alias("label"),
        "mentions", spread_confidence("_spread").alias("confidence"), "_first")
    strongest = Window.partitionBy("run_date").orderBy(F.desc(F.abs("score")), "_first")
    return kept.withColumn("rank", F.row_number().over(strongest)).drop("_first")


def _spellings(items: DataFrame, column: str) -> DataFrame:
    """Distinct spellings per day and case-folded key, with count and first encounter.

    Counting spellings first keeps the wide step a hash aggregate; choosing the first-seen
    spelling then works on few rows.
    """
    words = (items.select("run_date", "ingest_seq", F.posexplode(column).alias("_pos", "_v"))
             .withColumn("_shown", strip("_v")).filter("_shown != ''")
             .groupBy("run_date", F.lower("_shown").alias("_key"), "_shown")
             .agg(F.count(F.lit(1)).alias("_n"), F.min(_encounter()).alias("_first")))
    return words.groupBy("run_date", "_key").agg(
        F.sum("_n").alias("n"), F.min("_first").alias("_first"), F.min_by("_shown", "_first").alias("_shown"))


def top_themes(items: DataFrame, n: int = config.TOP_THEMES) -> DataFrame:
    """The n most frequent themes per day, first-seen spelling, ties in order of appearance."""
    order = Window.partitionBy("run_date").orderBy(F.desc("n"), "_first")
    return (_spellings(items, "themes").withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= n).select("run_date", "rank", F.col("_shown").alias("theme"), "n"))


def distinct_signals(items: DataFrame, column: str, n: int = config.TOP_SIGNALS) -> DataFrame:
    """The first n distinct signals per day, case-insensitive, in order of appearance."""
    order = Window.partitionBy("run_date").orderBy("_first")
    return (_spellings(items, column).withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= n).select("run_date", "rank", F.col("_shown").alias("signal")))


def _entries() -> Column:
    """What an item adds to its day: its tier, and every ticker, theme and signal with its position."""
    def listed(kind: str, column: str, key) -> Column:
        shown = F.transform(F.coalesce(column, F.array()), lambda v, i: F.struct(
            F.lit(kind).alias("kind"), key(strip(v)).alias("key"), strip(v).alias("shown"), i.alias("_pos")))
        return shown
    tier = F.array(F.struct(F.lit("tier").alias("kind"), F.col("source_tier").cast("string").alias("key"),
                            F.lit("").alias("shown"), F.lit(0).alias("_pos")))
    return F.concat(tier, listed("ticker", "tickers", F.upper), listed("theme", "themes", F.lower),
                    listed("bull", "bull_signals", F.lower), listed("bear", "bear_signals", F.lower))


def _day_entries(items: DataFrame) -> DataFrame:
    """Sums, counts and first encounter per day, kind and key, from one scan of the items."""
    long = (items.select("run_date", "ingest_seq", "weight", "sentiment_score", "source_tier", F.inline(_entries()))
            .filter("key != '' or kind = 'tier'")
            .filter((F.col("kind") != "ticker") | is_directional("source_tier"))
            .withColumn("shown", F.when(F.col("kind").isin("ticker", "tier"), F.lit("")).otherwise(F.col("shown"))))
    spelled = long.groupBy("run_date", "kind", "key", "shown").agg(
        F.sum("weight").alias("_w"), F.sum(F.col("weight") * F.col("sentiment_score")).alias("_wv"),
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("weight") > 0).alias("_contributing"),
        F.stddev_pop("sentiment_score").alias("_spread"), F.min(_encounter()).alias("_first"))
    # tickers and tiers have one spelling, so their spread passes through
    return spelled.groupBy("run_date", "kind", "key").agg(
        F.sum("_w").alias("_w"), F.sum("_wv").alias("_wv"), F.sum("_n").alias("n"), F.sum("_contributing").alias("_contributing"),
        F.max("_spread").alias("_spread"), F.min_by("shown", "_first").alias("shown"), F.min("_first").alias("_first"))


def daily_consensus(scored: DataFrame, now: Column | None = None) -> DataFrame:
    """The full daily row (``schemas.DAILY``), from one scan of the items.

    Tiers, tickers, themes and signals are entries of one long table with one aggregate; ranks
    and lists then work on a day's distinct keys.
    """
    entries = _day_entries(weighted(scored, now))
    kind, mean = F.col("kind"), F.coalesce(F.try_divide("_wv", "_w"), F.lit(0.0))
    rated = (entries.withColumn("_mean", mean).withColumn("_score", py_round("_mean", 4))
             .filter((kind != "ticker") | (F.col("n") >= config.MIN_TICKER_MENTIONS)))
    strength = F.when(kind == "ticker", F.abs("_score")).when(kind == "theme", F.col("n").cast("double")).otherwise(0.0)
    # tickers and tiers are all kept, so each stands alone; the plain bound lets a task drop the rest before the shuffle
    alone = F.when(kind.isin("tier", "ticker"), F.col("key"))
    order = Window.partitionBy("run_date", "kind", alone).orderBy(F.desc(strength), "_first")
    bound = F.when(kind == "theme", config.TOP_THEMES).otherwise(config.TOP_SIGNALS)
    ranked = (rated.withColumn("_order", -strength).withColumn("rank", F.row_number().over(order))
              .filter(F.col("rank") <= max(config.TOP_THEMES, config.TOP_SIGNALS)).filter(F.col("rank") <= bound))
    tier, directional = kind == "tier", (kind == "tier") & is_directional(F.col("key").try_cast("int"))

    def listed(of: str, value: Column) -> Column:
        pairs = F.array_sort(F.collect_list(F.when(kind == of, F.struct("_order", "_first", value.alias("v")))))
        return F.transform(pairs, lambda s: s["v"])
    days = ranked.groupBy("run_date").agg(
        F.coalesce(F.try_divide(F.sum(F.when(tier, F.col("_wv"))), F.sum(F.when(tier, F.col("_w")))), F.lit(0.0)).alias("_consensus"),
        F.sum(F.when(tier, F.col("n"))).alias("item_count"),
        F.sum(F.when(tier, F.col("_contributing"))).alias("contributing_count"),
        F.coalesce(F.stddev_pop(F.when(directional, F.col("_mean"))), F.lit(0.0)).alias("_dispersion"),
        F.count(F.when(directional, F.col("_mean"))).alias("_tiers"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(
            directional, F.struct(F.col("key").try_cast("int"), F.col("_score")))))).alias("tier_means"),
        listed("ticker", F.struct(F.col("key").alias("ticker"), F.col("_score").alias("score"), daily_label("_mean").alias("label"),
                                  F.col("n").alias("mentions"), spread_confidence("_spread").alias("confidence"))).alias("tickers"),
        listed("theme", F.struct(F.col("shown").alias("theme"), "n")).alias("top_themes"),
        listed("bull", F.col("shown")).alias("bull_signals"), listed("bear", F.col("shown")).alias("bear_signals"))
    return days.select("run_date", *_headline_columns(), "tickers", "top_themes", "bull_signals", "bear_signals")
