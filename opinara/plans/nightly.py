"""The nightly run: take in new episodes first, then refresh the stalest readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from opinara import config, schemas
from opinara.operators.coverage import episode_outcomes, unseen, with_display, with_stored_counts
from opinara.operators.mentions import AliasSet, episodes_naming_a_subject
from opinara.operators.passages import build_passages
from opinara.operators.readings import stale_readings
from opinara.operators.scoring import parse_stance, require_working_scorer, score_with, stance_requests
from opinara.operators.store import OpinionStore
from opinara.plans.readings import compute_readings, query_vectors
from opinara.session import scratch_path


def _materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: what follows must not repeat paid work."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ingest(spark: SparkSession, store: OpinionStore, episodes: DataFrame, segments: DataFrame, aliases: AliasSet,
           dim: DataFrame, scorer, embed, now: Column, budget: int = 5) -> int:
    """New episodes to stored items; every judged episode goes to the ledger, deferred ones do not.

    A broken scorer raises before anything is written.
    """
    fresh = unseen(episodes, store.ledger())
    named = episodes_naming_a_subject(fresh, aliases).select("guid", F.lit(True).alias("named"))
    lengths = segments.groupBy("guid").agg(F.count(F.lit(1)).alias("n_segments"))
    flagged = (fresh.join(named, "guid", "left").join(lengths, "guid", "left")
               .fillna(False, ["named"]).fillna(0, ["n_segments"]).withColumn("error", F.lit(None).cast("string")))
    outcomes = _materialize(spark, episode_outcomes(flagged, budget).filter("status is not null"), "outcomes")
    chosen = outcomes.filter("status = 'ok'")
    passages = _materialize(spark, with_display(build_passages(
        segments.join(chosen.select("guid"), "guid", "left_semi"), aliases, chosen), dim), "passages")
    requests = stance_requests(passages.withColumn("idx", F.col("external_id")))
    responses = _materialize(spark, score_with(requests, scorer), "responses")
    require_working_scorer(responses, "podcast passages")
    kept = parse_stance(responses).filter("drop_reason is null").select("custom_id", "score", "rationale")
    scored = (passages.withColumn("custom_id", F.concat(F.lit("item-"), "external_id")).join(kept, "custom_id")
              .withColumn("author", F.lit(None).cast("string")).withColumn("created_at", now)
              .withColumn("ingest_seq", F.col("seg_idx").cast("bigint")))
    stored = store.append_items(embed(scored))
    made = passages.groupBy("guid").agg(F.count(F.lit(1)).cast("int").alias("n_passages"))
    marked = (with_stored_counts(outcomes.join(made, "guid", "left").fillna(0, ["n_passages"]), scored)
              .withColumn("processed_at", now).select(*schemas.LEDGER.fieldNames()))
    store.mark_episodes(marked)
    return stored


def refresh(store: OpinionStore, subjects: DataFrame, prices: DataFrame, now: Column,
            max_age_hours: float = config.READING_MAX_AGE_HOURS, cap: int = config.STALE_REFRESH_CAP,
            embed=None, k: int = config.SEARCH_K) -> None:
    """Recompute the stalest readings, up to ``cap`` subjects, in one job.

    With ``embed`` each reading is made from the k items closest to its subject's query.
    """
    stale = stale_readings(store.readings(), now, max_age_hours, cap).select("subject")
    due = subjects.join(stale, "subject", "left_semi")
    items = store.items().withColumn("similarity", F.lit(0.0))
    queries = None if embed is None else query_vectors(due, embed)
    store.save_readings(compute_readings(due, items, prices, now, queries=queries, k=k))
