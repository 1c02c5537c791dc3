"""Reports about the corpus itself: coverage, passage yield, episode outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from opinara import config
from opinara.functions.text import strip

BUCKETS = ("rich", "ok", "thin", "empty", "error")


def coverage_bucket(volume: Column | str, error: Column | None = None) -> Column:
    v = F.col(volume) if isinstance(volume, str) else volume
    bucket = (F.when(v >= config.COVERAGE_RICH, "rich").when(v >= config.COVERAGE_OK, "ok")
              .when(v >= config.COVERAGE_THIN, "thin").otherwise("empty"))
    return bucket if error is None else F.when(error, "error").otherwise(bucket)


def coverage_rows(subjects: DataFrame, failed: Column | None = None) -> DataFrame:
    """``subject, kind, volume, coverage``, largest volume first; a failed subject has volume 0."""
    volume = F.coalesce("volume", F.lit(0)).cast("bigint")
    if failed is not None:
        volume = F.when(failed, F.lit(0)).otherwise(volume)
    return (subjects.select("subject", "kind", volume.alias("volume"),
                            coverage_bucket(volume, failed).alias("coverage"))
            .orderBy(F.desc("volume"), "subject"))


def coverage_report(rows: DataFrame) -> DataFrame:
    """Per kind: subjects, the upper median volume and how many fall in each bucket.

    The upper median is the discrete median from the top; the aggregate keeps counts per
    distinct volume, not the rows.
    """
    return rows.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"),
        F.expr("percentile_disc(0.5) within group (order by volume desc)").cast("bigint").alias("median_items"),
        *[F.count_if(F.col("coverage") == b).alias(b) for b in BUCKETS])


def passage_yield(candidates: DataFrame, kept: DataFrame, by: str) -> DataFrame:
    """Candidate passages and how many carried a view, per subject or episode."""
    c = candidates.groupBy(by).agg(F.count(F.lit(1)).alias("candidates"))
    k = kept.groupBy(by).agg(F.count(F.lit(1)).alias("kept"))
    return c.join(k, by, "left").fillna(0, ["kept"])


# --- episodes ----------------------------------------------------------------------------------
def unseen(episodes: DataFrame, ledger: DataFrame) -> DataFrame:
    return episodes.join(ledger.select("guid"), "guid", "left_anti")


def budget_cutoff(successes: DataFrame, budget: int) -> Column:
    """Feed position of the run's last affordable success, null while the budget lasts.

    A bounded top-k over the successes; no running count over all episodes.
    """
    position = F.struct("show_idx", "feed_idx")
    head = successes.select("show_idx", "feed_idx").orderBy("show_idx", "feed_idx").limit(budget)
    return head.agg(F.when(F.count(F.lit(1)) >= budget, F.max(position)).alias("cut")).scalar()


def episode_outcomes(episodes: DataFrame, budget: int, allow_audio: bool = True) -> DataFrame:
    """Adds ``status, detail`` to episodes with ``named, transcript_url, audio_url, n_segments, error``.

    Successes use the budget in feed order; skips and failures do not.  A null status means the
    episode is left for a later run and must not be written to the ledger.
    """
    attempt = F.col("named") & (F.lit(allow_audio) | F.col("transcript_url").isNotNull())
    homeless = F.col("transcript_url").isNull() & F.col("audio_url").isNull()
    error = F.coalesce("error", F.when(homeless, F.lit(config.DETAIL_HOMELESS)))
    judged = episodes.withColumn("_attempt", attempt).withColumn("_error", error)
    success = F.col("_attempt") & F.col("_error").isNull() & (F.col("n_segments") > 0)
    cut = budget_cutoff(judged.filter(success), budget)
    beyond = F.coalesce(F.struct("show_idx", "feed_idx") > cut, F.lit(False)) if budget > 0 else F.lit(True)
    status = (F.when(~F.col("named"), "skipped").when(beyond | ~F.col("_attempt"), None)
              .when(F.col("_error").isNotNull(), "failed").when(F.col("n_segments") <= 0, "skipped").otherwise("ok"))
    detail = (F.when(~F.col("named"), config.DETAIL_NOT_NAMED)
              .when(F.col("status") == "failed", F.col("_error"))
              .when(F.col("status") == "skipped", config.DETAIL_NO_TEXT))
    return judged.withColumn("status", status).withColumn("detail", detail).drop("_attempt", "_error")


def with_stored_counts(outcomes: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored items per episode back onto the outcomes, by the guid column."""
    counts = stored.groupBy("guid").agg(F.count(F.lit(1)).cast("int").alias("n_items"))
    return outcomes.drop("n_items").join(counts, "guid", "left").fillna(0, ["n_items"])


def with_display(df: DataFrame, dim: DataFrame, key: str = "subject") -> DataFrame:
    """Display name of a subject, else its key."""
    names = dim.select(F.col("proxy").alias(key), F.col("display"))
    return df.join(names, key, "left").withColumn("display", F.coalesce("display", key))


def requested_basket(requested: DataFrame, known: DataFrame) -> DataFrame:
    """Requested tickers with their search phrase, the ticker itself when unknown."""
    wanted = requested.select(F.upper(strip("ticker")).alias("ticker")).distinct()
    return wanted.join(known, "ticker", "left").withColumn("query", F.coalesce("query", "ticker"))


def resolve_subjects(requests: DataFrame, dim: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Free-text requests to subjects of the dimension; second frame: those left to resolve."""
    from opinara.functions.scalars import resolver_key, subject_key

    joined = requests.withColumn("input_key", resolver_key(text)).join(dim, "input_key", "left")
    known = joined.filter(F.col("display").isNotNull()).withColumn("subject", subject_key("proxy", "display"))
    return known, joined.filter(F.col("display").isNull()).select(*requests.columns, "input_key")


def first_n(df: DataFrame, n: int, by: list[str], order: str = "ingest_seq") -> DataFrame:
    """The first n rows of each group in an explicit order."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
