"""The tables of one deployment, as a small catalogue over the sinks and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from opinara import config, schemas
from opinara.operators import readings as R
from opinara.operators.search import semantic_search
from opinara.sources import sinks


_READING_KEYS = ["subject", "computed_at"]


class OpinionStore:
    """Items, readings, episode ledger and daily rows below one shared folder.

    Another back end only has to offer the same methods.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    # --- items ----------------------------------------------------------------------------
    def items(self, subject: str | None = None) -> DataFrame:
        table = sinks.read_table(self.spark, self._path("item"), schemas.ITEM)
        return table if subject is None else table.filter(F.col("subject") == subject)

    def append_items(self, batch: DataFrame) -> int:
        return sinks.append_items(self.spark, self._path("item"), batch, schemas.ITEM)

    def search(self, query: list[float], k: int = 200, subject: str | None = None) -> DataFrame:
        return semantic_search(self.items(), query, k, subject)

    def corpus_size(self) -> DataFrame:
        return R.corpus_size(self.items())

    def item_counts(self, subjects: DataFrame) -> DataFrame:
        return R.items_per_subject(subjects, self.items())

    def known_ids(self, batch: DataFrame) -> DataFrame:
        """Ids of the batch that the corpus already has."""
        return sinks.known_keys(self.spark, self._path("item"), batch.select(sinks.item_key().alias("external_id")))

    def drop_known(self, batch: DataFrame) -> DataFrame:
        """The batch without known items; run this ahead of scoring."""
        keyed = batch.withColumn("_key", sinks.item_key())
        return keyed.join(self.known_ids(batch).withColumnRenamed("external_id", "_key"), "_key", "left_anti").drop("_key")

    # --- readings --------------------------------------------------------------------------
    def readings(self) -> DataFrame:
        return sinks.read_latest(self.spark, self._path("subject_reading"), schemas.READING, _READING_KEYS)

    def save_readings(self, batch: DataFrame, write_seq: str | None = None) -> None:
        sinks.upsert(self.spark, self._path("subject_reading"), batch, _READING_KEYS,
                     schemas.READING, "subject", write_seq)

    def latest_reading(self, subject: str | None = None) -> DataFrame:
        rows = self.readings()
        return R.latest_reading(rows if subject is None else rows.filter(F.col("subject") == subject))

    def history(self, subject: str, limit: int = config.HISTORY_LIMIT) -> DataFrame:
        return R.reading_history(self.readings().filter(F.col("subject") == subject), limit)

    def readings_since(self, since: Column) -> DataFrame:
        return R.readings_since(self.readings(), since)

    # --- episodes ----------------------------------------------------------------------------
    def ledger(self) -> DataFrame:
        return sinks.read_latest(self.spark, self._path("processed_episode"), schemas.LEDGER, ["guid"])

    def mark_episodes(self, batch: DataFrame, write_seq: str | None = None) -> None:
        sinks.upsert(self.spark, self._path("processed_episode"), batch, ["guid"], schemas.LEDGER, None, write_seq)

    def ledger_stats(self) -> DataFrame:
        return R.ledger_stats(self.ledger())

    # --- daily rows -----------------------------------------------------------------------------
    def daily(self) -> DataFrame:
        return sinks.read_latest(self.spark, self._path("daily_consensus"), schemas.DAILY, ["run_date"])

    def save_daily(self, batch: DataFrame, write_seq: str | None = None) -> None:
        sinks.upsert(self.spark, self._path("daily_consensus"), batch, ["run_date"], schemas.DAILY, None, write_seq)

    # --- upkeep -------------------------------------------------------------------------------------
    def compact(self) -> None:
        """Leave out replaced readings, ledger and daily rows; items are never replaced."""
        sinks.compact(self.spark, self._path("subject_reading"), schemas.READING, _READING_KEYS, "subject")
        sinks.compact(self.spark, self._path("processed_episode"), schemas.LEDGER, ["guid"])
        sinks.compact(self.spark, self._path("daily_consensus"), schemas.DAILY, ["run_date"])
