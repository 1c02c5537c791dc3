"""Record-level projections and predicates: one narrow pass, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from opinara import config
from opinara.functions.scalars import age_hours, clamp, is_directional, tier_for_source
from opinara.functions.text import strip


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def engagement(score: Column | str) -> Column:
    """A numeric engagement value, fraction cut off; anything else counts 0."""
    value = _col(score).try_cast("double")
    return F.coalesce(F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)), F.lit(0)).cast("bigint")


def json_engagement(payload: Column | str, path: str = "$.score") -> Column:
    """Engagement out of a JSON metadata text; only a number or a truth value (1 or 0) counts."""
    document = F.try_parse_json(_col(payload))
    kind = F.schema_of_variant(F.try_variant_get(document, path, "variant"))
    text = F.try_variant_get(document, path, "string")
    return (F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), engagement(text))
            .when(kind == "BOOLEAN", (text == "true").cast("bigint")).otherwise(F.lit(0).cast("bigint")))


def normalize(raw: DataFrame) -> DataFrame:
    """Raw records to the canonical shape."""
    source = F.coalesce("source", F.lit(""))
    return raw.select(
        source.alias("source"), tier_for_source(source).alias("source_tier"),
        strip(F.coalesce("title", F.lit(""))).alias("title"),
        F.substring(strip(F.coalesce("text", F.lit(""))), 1, config.NORMALIZED_TEXT_CHARS).alias("text"),
        F.coalesce("url", F.lit("")).alias("url"), F.col("ts"),
        engagement("metadata.score").alias("raw_engagement"), "ingest_seq")


# --- filters ----------------------------------------------------------------------------
def for_subject(items: DataFrame, subject: str | None) -> DataFrame:
    """Subject filter; ``None`` means all.  On a table partitioned by subject it prunes files."""
    return items if subject is None else items.filter(F.col("subject") == subject)


def with_embedding(items: DataFrame) -> DataFrame:
    return items.filter(F.col("embedding").isNotNull())


def scored_only(items: DataFrame) -> DataFrame:
    return items.filter(F.col("score").isNotNull())


def dated_only(items: DataFrame) -> DataFrame:
    return items.filter(F.col("ts").isNotNull())


def with_text(items: DataFrame) -> DataFrame:
    return items.filter(strip(F.coalesce("text", F.lit(""))) != "")


def relevant_only(items: DataFrame) -> DataFrame:
    return items.filter(F.coalesce("relevant", F.lit(False)))


def directional_only(items: DataFrame) -> DataFrame:
    return items.filter(is_directional("source_tier"))


def market_split(subjects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Subjects with a tradeable proxy, and those out of scope."""
    ok = F.coalesce("is_financial", F.lit(False)) & (F.coalesce("proxy", F.lit("")) != "")
    return subjects.filter(ok), subjects.filter(~ok)


def fresh_readings(readings: DataFrame, now: Column, max_age_hours: float = config.READING_MAX_AGE_HOURS) -> DataFrame:
    """Readings young enough to serve as they are; marked ``cached``."""
    return (readings.filter(age_hours("computed_at", now) <= max_age_hours)
            .withColumn("cached", F.lit(True)))


def thin_subjects(subject_counts: DataFrame, limit: int = config.THIN_CORPUS) -> DataFrame:
    return subject_counts.filter(F.col("n_items") < limit)


# --- projections ------------------------------------------------------------------------
def clamp_sentiment(score: Column | str) -> Column:
    return clamp(_col(score).cast("double"), -1.0, 1.0)


def citation_struct() -> Column:
    return F.struct(F.col("n").cast("int").alias("n"), F.col("source"), F.col("url"),
                    F.col("score").cast("int").alias("score"),
                    F.substring("text", 1, config.QUOTE_CHARS).alias("quote"))


def report_line() -> Column:
    """The numbered line a report writer gets for one citation."""
    return F.format_string("[%d] (%s, stance %+d) %s", F.col("n").cast("int"), F.col("source"),
                           F.col("score").cast("int"), F.substring("text", 1, config.REPORT_LINE_CHARS))


def decode_readings(stored: DataFrame, citations_json: str = "citations", backtest_json: str = "backtest") -> DataFrame:
    """Stored readings with JSON columns to typed readings; no citations means an empty list."""
    from opinara import schemas
    return (stored.withColumn("is_financial", F.coalesce(F.col("is_financial").cast("boolean"), F.lit(False)))
            .withColumn(citations_json, F.coalesce(
                F.from_json(citations_json, f"array<{schemas.CITATION}>"),
                F.from_json(F.lit("[]"), f"array<{schemas.CITATION}>")))
            .withColumn(backtest_json, F.from_json(backtest_json, schemas.BACKTEST)))
