"""The exchange with a stance or sentiment model: requests out, responses in, failures judged.

The model itself is outside.  A scorer is either a table of landed responses keyed by
``custom_id`` or a ``mapInPandas`` function from requests to responses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from opinara import config, schemas
from opinara.functions.text import strip


class ScoringFailed(RuntimeError):
    """The scorer is broken; its output must not be read as low coverage."""


# --- requests ---------------------------------------------------------------------------
def custom_id(index: Column | str) -> Column:
    return F.concat(F.lit("item-"), (F.col(index) if isinstance(index, str) else index).cast("string"))


def stance_requests(items: DataFrame, index: str = "idx", display: str = "display") -> DataFrame:
    """One request row per item: subject, title and the start of the text."""
    body = F.concat(F.lit("SUBJECT: "), F.col(display), F.lit("\n\nPOST TITLE: "), F.coalesce("title", F.lit("")),
                    F.lit("\n\nPOST BODY: "), F.substring(F.coalesce("text", F.lit("")), 1, config.STANCE_TEXT_CHARS))
    return items.select(custom_id(index).alias("custom_id"), body.alias("content"))


def sentiment_requests(items: DataFrame, index: str = "idx") -> DataFrame:
    """One request row per canonical record: source, title, text."""
    body = F.concat(F.lit("SOURCE: "), F.col("source"), F.lit("\nTITLE: "), F.col("title"),
                    F.lit("\nCONTENT: "), F.col("text"))
    return items.select(custom_id(index).alias("custom_id"), body.alias("content"))


# --- responses -----------------------------------------------------------------------------
def _field(document: str, name: str) -> tuple[Column, Column]:
    """Type and text of a field of a JSON document; both null where it is missing."""
    value = F.try_variant_get(F.col(document), f"$.{name}", "variant")
    return F.schema_of_variant(value), F.try_variant_get(F.col(document), f"$.{name}", "string")


NUMBERS = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def _python_int(kind: Column, text: Column) -> Column:
    """``int(value)`` of a JSON value: a number is cut, quoted whole numbers are read, true is 1."""
    return (F.when(kind.rlike(NUMBERS), text.try_cast("double").try_cast("int"))
            .when((kind == "STRING") & strip(text).rlike(r"^[+-]?\d+$"), strip(text).try_cast("int"))
            .when(kind == "BOOLEAN", (text == "true").cast("int")))


def _python_truth(document: str, name: str) -> Column:
    """Whether a JSON value counts as true: not null, false, zero, nor an empty text, list or object."""
    kind, text = _field(document, name)
    whole = F.to_json(F.try_variant_get(F.col(document), f"$.{name}", "variant"))
    return F.coalesce(F.when(kind == "BOOLEAN", text == "true").when(kind == "STRING", text != "")
                      .when(kind.rlike(NUMBERS), text.try_cast("double") != 0).when(kind == "VOID", F.lit(False))
                      .otherwise(~whole.isin("[]", "{}")), F.lit(False))


def parse_stance(responses: DataFrame, body: str = "body", prefill: str = "") -> DataFrame:
    """Adds ``relevant, score, rationale, drop_reason``; a null reason means the item is kept.

    ``prefill`` is text the model was made to start with and that its answer therefore lacks.
    """
    body = F.concat(F.lit(prefill), F.col(body))
    failed = F.col("error_class").isNotNull() if "error_class" in responses.columns else F.lit(False)
    an_object = F.coalesce(strip(body).startswith("{"), F.lit(False))
    return (responses.withColumn("_p", F.when(an_object, F.try_parse_json(body)))
            .withColumn("relevant", _python_truth("_p", "relevant")).withColumn("score", _python_int(*_field("_p", "score")))
            .withColumn("rationale", F.coalesce(_field("_p", "rationale")[1], F.lit("")))
            .withColumn("drop_reason",
                        F.when(failed, "error").when(F.col("_p").isNull(), "unparseable")
                        .when(~F.col("relevant"), "irrelevant").when(F.col("score").isNull(), "no score"))
            .drop("_p"))


SENTIMENT = ("struct<sentiment_score:double,tickers:array<string>,themes:array<string>,"
             "bull_signals:array<string>,bear_signals:array<string>>")


def parse_sentiment(responses: DataFrame, body: str = "body") -> DataFrame:
    """Structured sentiment; a response missing any field is dropped as unparseable."""
    from opinara.operators.records import clamp_sentiment

    parsed = F.from_json(body, SENTIMENT)
    fields = ("sentiment_score", "tickers", "themes", "bull_signals", "bear_signals")
    complete = F.lit(True)
    for f in fields:
        complete = complete & F.col(f"_p.{f}").isNotNull()
    out = responses.withColumn("_p", parsed).withColumn("_ok", F.coalesce(complete, F.lit(False)))
    return out.select(
        *responses.columns, clamp_sentiment("_p.sentiment_score").alias("sentiment_score"),
        *[F.col(f"_p.{f}").alias(f) for f in fields[1:]],
        F.when(~F.col("_ok"), "unparseable").alias("drop_reason"))


def align_responses(items: DataFrame, responses: DataFrame, index: str = "idx") -> tuple[DataFrame, DataFrame]:
    """Items with their parsed response by ``custom_id``; second frame: what was dropped and why."""
    keyed = items.withColumn("custom_id", custom_id(index))
    joined = keyed.join(responses, "custom_id", "left").withColumn(
        "drop_reason", F.when(F.col("relevant").isNull(), F.coalesce("drop_reason", F.lit("missing")))
        .otherwise(F.col("drop_reason")))
    kept = joined.filter("drop_reason is null").drop("drop_reason")
    return kept, joined.filter("drop_reason is not null").select("custom_id", index, "drop_reason")


# --- the error gate -----------------------------------------------------------------------------
def is_fatal(error_class: Column | str) -> Column:
    c = F.col(error_class) if isinstance(error_class, str) else error_class
    return F.coalesce(c.isin(*config.FATAL_ERROR_CLASSES), F.lit(False))


def error_rates(responses: DataFrame, by: list[str] | None = None,
                max_rate: float = config.MAX_ERROR_RATE) -> DataFrame:
    """Requests, errors, fatal errors and the verdict, over the batch or per group."""
    agg = responses.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.count("error_class").alias("errors"),
        F.count_if(is_fatal("error_class")).alias("fatal"))
    return agg.withColumn("error_rate", F.coalesce(F.try_divide("errors", "n"), F.lit(0.0))).withColumn(
        "broken", (F.col("fatal") > 0) | (F.col("error_rate") > max_rate))


def require_working_scorer(responses: DataFrame, subject: str = "batch") -> None:
    """Raise before anything is stored when the scorer failed."""
    row = error_rates(responses).first()
    if row.fatal:
        cause = (responses.filter(is_fatal("error_class")).select("error_class", "body").first())
        raise ScoringFailed(f"the scorer for {subject!r} cannot work: {row.fatal} requests met an error that no retry "
                            f"mends, such as {cause.error_class} ({cause.body})")
    if row.broken:
        raise ScoringFailed(f"the scorer for {subject!r} answered {row.errors} of {row.n} requests with an error; "
                            "nothing is stored, because that would pass for low coverage")


# --- scorer plug-in --------------------------------------------------------------------------------
def score_with(requests: DataFrame, scorer) -> DataFrame:
    """Run an injected scorer: a function over batches (iterator of pandas frames with
    ``custom_id, content``) that yields frames ``custom_id, body, error_class``."""
    return requests.mapInPandas(scorer, schemas.RESPONSE)


def attach_scores(items: DataFrame, scores: DataFrame, vectors: DataFrame | None = None,
                  key: str = "external_id") -> DataFrame:
    """Scores, and vectors when given, back onto items by key."""
    out = items.join(scores, key)
    return out if vectors is None else out.join(vectors, key)
