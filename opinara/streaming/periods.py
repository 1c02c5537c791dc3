"""Weekly readings that follow the item stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from opinara.functions.rounding import py_round
from opinara.functions.scalars import bucket_key
from opinara.operators.readings import period_readings
from opinara.operators.store import OpinionStore
from opinara.sources import sinks

WEEKLY = "subject string, period string, consensus double, n bigint"


def weekly_readings_stream(items: DataFrame, delay: str = "1 day", min_items: int = 1) -> DataFrame:
    """Mean stance per subject and Monday week; a week is emitted once the watermark passes it.

    The epoch is a Thursday, so seven-day windows are shifted by four days.
    """
    week = F.window("ts", "7 days", startTime="4 days")
    agg = (items.filter(F.col("score").isNotNull()).withWatermark("ts", delay).groupBy("subject", week)
           .agg(F.avg(F.col("score").cast("bigint")).alias("_mean"), F.count(F.lit(1)).alias("n")))
    return agg.filter(F.col("n") >= min_items).select(
        "subject", F.date_format(F.col("window.start"), "yyyy-MM-dd").alias("period"),
        py_round("_mean", 1).alias("consensus"), "n")


def _weekly_schema():
    from pyspark.sql.types import StructType

    return StructType.fromDDL(WEEKLY)


def follow_items(items: DataFrame, store: OpinionStore, target: str, checkpoint: str):
    """Start a run over all items that have landed: store them, and bring the weeks that they touch up to date.

    The stream carries no sums.  A micro-batch only says which (subject, week) it touches; those are computed
    anew from the stored items, so an item counts however late it comes.  Storing ignores known items and
    readings replace each other by key: a replayed batch changes nothing.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        store.append_items(batch)
        touched = batch.select("subject", bucket_key("ts", "week").alias("_week")).distinct()
        stored = store.items().withColumn("_week", bucket_key("ts", "week")).join(touched, ["subject", "_week"], "left_semi")
        weeks = period_readings(stored.drop("_week"), "week").select("subject", "period", "consensus", F.col("n").cast("bigint").alias("n"))
        sinks.upsert(batch.sparkSession, target, weeks, ["subject", "period"], _weekly_schema())
    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def followed_weeks(spark, target: str, min_items: int = 1) -> DataFrame:
    """The weekly readings kept by ``follow_items``."""
    return sinks.read_latest(spark, target, _weekly_schema(), ["subject", "period"]).filter(F.col("n") >= min_items)
