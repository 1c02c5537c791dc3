"""From stored items to complete readings, for any number of subjects in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from opinara import config, schemas
from opinara.operators import readings as R
from opinara.operators.coverage import resolve_subjects
from opinara.operators.records import fresh_readings, market_split, thin_subjects
from opinara.operators.scoring import parse_stance, require_working_scorer, score_with, stance_requests
from opinara.operators.search import search_many
from opinara.operators.study import backtest_panel
from opinara.session import scratch_path
from opinara.sources.sinks import first_wins, item_key


def written(df: DataFrame, name: str) -> DataFrame:
    """Written once and read back: what follows repeats neither the scan nor paid work."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def query_vectors(subjects: DataFrame, embed) -> DataFrame:
    """``(subject, query_vector)``: the display name and search phrase of each subject, embedded.

    ``embed`` adds ``embedding`` to rows with ``text``.
    """
    phrase = F.coalesce("query", F.lit("")) if "query" in subjects.columns else F.lit("")
    texts = subjects.select("subject", F.concat(F.coalesce("display", F.lit("")), F.lit(" \u2014 "), phrase).alias("text"))
    return embed(texts).select("subject", F.col("embedding").alias("query_vector"))


def retrieve(items: DataFrame, queries: DataFrame, k: int = config.SEARCH_K) -> DataFrame:
    """The k items of each subject that are closest to its query vector (``subject, query_vector``)."""
    return search_many(items.drop("similarity"), queries.withColumn("query_id", F.col("subject")), k).drop("query_id", "rank")


def compute_readings(subjects: DataFrame, items: DataFrame, prices: DataFrame, now: Column,
                     period: str = "month", queries: DataFrame | None = None, k: int = config.SEARCH_K) -> DataFrame:
    """Readings of ``subjects`` (``subject, proxy, display, asset_type``) from their retrieved items.

    With ``queries`` (``subject, query_vector``) a reading only sees the k items closest to its
    query; they are written once, at most k rows per subject, and headline numbers, citations
    and the price panel are aggregates of that table.  Without, all items with their
    ``similarity`` count.  A subject without items gets no reading.
    """
    scoped = items.join(subjects.select("subject"), "subject", "left_semi")
    if queries is not None:
        scoped = written(retrieve(scoped, queries, k), "retrieved")
    numbers = R.subject_reading(scoped)
    cited = R.citation_arrays(R.pick_citations(scoped))
    conviction = R.period_readings(scoped, period)
    proxied = prices.join(subjects.select(F.col("proxy").alias("symbol"), "subject"), "symbol")
    panel = backtest_panel(conviction, proxied.select(F.col("subject").alias("symbol"), "period", "close"), period)
    out = (subjects.join(numbers, "subject").join(cited, "subject", "left").join(panel, "subject", "left")
           .withColumn("computed_at", now).withColumn("is_financial", F.lit(True))
           .withColumn("report_md", F.lit(None).cast("string"))
           .withColumn("backtest", F.col("backtest").withField("proxy", F.when(
               F.col("backtest.n_pairs").isNotNull(), F.col("proxy")))))
    return out.select(*schemas.READING.fieldNames())


def answer(requests: DataFrame, dim: DataFrame, readings: DataFrame, items: DataFrame, prices: DataFrame,
           now: Column, max_age_hours: float = config.READING_MAX_AGE_HOURS, period: str = "month",
           embed=None, k: int = config.SEARCH_K, force_refresh: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Free-text requests to readings.

    Returns what can be served (fresh stored readings, recomputed ones otherwise, marked by
    ``cached``; zero readings for subjects without items, which are not to be stored), the
    requests out of scope, and those that name no known subject.  ``embed`` makes query
    vectors, so that a reading is made from its k closest items; ``force_refresh`` passes by
    stored readings.
    """
    known, unresolved = resolve_subjects(requests, dim)
    known = written(known, "requests")
    # several spellings may name a subject; its row of least display name and so on stands for all
    columns = ["proxy", "display", "asset_type", "is_financial"]
    asked = known.groupBy("subject").agg(F.min(F.struct(*columns)).alias("a")).select("subject", "a.*")
    if force_refresh:
        readings = readings.limit(0)
    fresh = fresh_readings(R.latest_reading(readings.join(asked.select("subject"), "subject", "left_semi")), now, max_age_hours)
    # a row per subject without a fresh reading: numbers, citations, months and prices all look them up
    misses = written(asked.join(fresh.select("subject"), "subject", "left_anti"), "to-compute")
    market, out_of_scope = market_split(misses)
    queries = None if embed is None else query_vectors(market, embed)
    made = compute_readings(market, items, prices, now, period, queries, k)
    computed = R.reading_or_empty(market.drop("proxy", "display", "asset_type", "is_financial"), made)
    about = market.select("subject", *(F.col(c).alias(f"_{c}") for c in ("proxy", "display", "asset_type")))
    computed = computed.join(about, "subject")
    for c in ("proxy", "display", "asset_type"):
        computed = computed.withColumn(c, F.coalesce(c, f"_{c}"))
    computed = (computed.withColumn("computed_at", now).withColumn("is_financial", F.lit(True))
                .withColumn("citations", F.coalesce("citations", F.array())).withColumn("cached", F.lit(False)))
    served = fresh.select(*schemas.READING.fieldNames(), "cached").unionByName(
        computed.select(*schemas.READING.fieldNames(), "cached"))
    return served, out_of_scope.select("subject", "display"), unresolved


def refill(store, subjects: DataFrame, fetched: DataFrame, scorer, embed, force: bool = False) -> int:
    """Fetched items of subjects with a thin corpus, scored and stored; returns how many were new.

    ``subjects`` (``subject, display``) with fewer than ``config.THIN_CORPUS`` items (all with
    ``force``) take in their ``fetched`` rows (``schemas.ITEM`` without score, rationale and
    embedding).  What the corpus already has is dropped before it is scored, of repeated keys
    the first stays, rows without key are passed over.  A broken scorer raises and nothing is stored.
    """
    asked = subjects.select("subject", "display").distinct()
    thin = asked if force else asked.join(thin_subjects(store.item_counts(asked.select("subject"))).select("subject"), "subject", "left_semi")
    wanted = first_wins(fetched.join(thin, "subject"), item_key())
    new = written(store.drop_known(wanted).withColumn("external_id", item_key()), "fetched")
    responses = written(score_with(stance_requests(new, "external_id"), scorer), "responses")
    require_working_scorer(responses, "fetched items")
    kept = parse_stance(responses).filter("drop_reason is null").select("custom_id", "score", "rationale")
    scored = (new.drop("score", "rationale", "embedding").withColumn("custom_id", F.concat(F.lit("item-"), "external_id"))
              .join(kept, "custom_id").drop("custom_id", "display"))
    return store.append_items(embed(scored))


# --- read views --------------------------------------------------------------------------------
def corpus_stats(items: DataFrame) -> DataFrame:
    return R.corpus_size(items)


def latest_for(requests: DataFrame, dim: DataFrame, readings: DataFrame) -> DataFrame:
    """The newest reading of each free-text request."""
    known, _ = resolve_subjects(requests, dim)
    return known.select("text", "subject").join(R.latest_reading(readings), "subject")


def history_for(requests: DataFrame, dim: DataFrame, readings: DataFrame, limit: int = config.HISTORY_LIMIT) -> DataFrame:
    known, _ = resolve_subjects(requests, dim)
    asked = known.select("text", "subject")
    scoped = readings.join(asked.select("subject").distinct(), "subject", "left_semi")
    return asked.join(R.reading_history(scoped, limit), "subject")


def backtest_for(requests: DataFrame, dim: DataFrame, readings: DataFrame) -> DataFrame:
    """The price panel of the newest reading, or a note that there is none."""
    latest = latest_for(requests, dim, readings)
    return latest.select("text", "subject", "backtest",
                         F.when(F.col("backtest").isNull(), config.NO_BACKTEST).otherwise(F.col("backtest.note")).alias("note"))

