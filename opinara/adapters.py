"""Domain frames out of the benchmark tables, one projection each.

The same definitions exist as SQL in ``verification.sql_views`` for the comparison engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense items of one month, from the event stream."""
    kind = F.col("event_type")
    raw_score = F.floor(F.col("value") * 2).cast("int") - 70
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("ev:"), F.col("event_id")).alias("external_id"),
        F.concat(F.lit("U"), F.col("user_id") % 10).alias("subject"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("ingest_seq"),
        F.greatest(F.lit(-100), F.least(F.lit(100), raw_score)).cast("int").alias("score"),
        F.when(kind == "error", "arxiv").when(kind == "purchase", "news:feed")
        .otherwise(F.concat(F.lit("reddit/r/"), kind)).alias("source"),
        F.get_json_object("props", "$.k").cast("bigint").alias("raw_engagement"),
        F.concat(F.lit("post "), F.col("event_id"), F.lit(" "), kind).alias("text"),
        F.concat(F.lit("https://posts.example/"), F.col("event_id")).alias("url"),
        (((F.col("event_id") * 7919) % 10007) / F.lit(10007.0)).alias("similarity"),
        kind.alias("event_type"), F.col("user_id"), F.col("event_id"), F.col("value"))


def daily_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored canonical records with tickers, themes and signals."""
    from opinara.functions.scalars import tier_for_source

    items = items_e(spark, sf_dir)
    signal = F.concat("event_type", F.lit(" "), F.col("user_id") % 17)
    none = F.array().cast("array<string>")
    return items.select(
        F.col("ts").cast("date").alias("run_date"), "ingest_seq", "ts", "source",
        tier_for_source("source").alias("source_tier"), "raw_engagement",
        (F.col("score") / F.lit(100.0)).alias("sentiment_score"),
        F.array("subject", F.upper("event_type")).alias("tickers"),
        F.array(F.concat(F.upper(F.substring("event_type", 1, 1)), F.substring("event_type", 2, 20)),
                F.concat(F.lit(" u"), F.col("user_id") % 13)).alias("themes"),
        F.when(F.col("score") > 0, F.array(signal)).otherwise(none).alias("bull_signals"),
        F.when(F.col("score") < 0, F.array(signal)).otherwise(none).alias("bear_signals"))


def items_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items over 80 months, from orders and customers."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return (orders.join(customer, orders.o_custkey == customer.c_custkey)
            .select(F.concat(F.lit("o:"), F.col("o_orderkey")).alias("external_id"),
                    F.col("c_mktsegment").alias("subject"), F.col("o_orderdate").cast("timestamp").alias("ts"),
                    (F.floor(F.col("o_totalprice") % 201).cast("int") - 100).alias("score"),
                    F.col("c_nationkey").alias("nation")))


def items_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``items_o`` with a finer subject: segment and nation."""
    return items_o(spark, sf_dir).withColumn("subject", F.concat_ws("-", "subject", "nation"))


def bars(spark: SparkSession, sf_dir: str, fine: bool = False) -> DataFrame:
    """Daily price bars per market segment (and nation when ``fine``), from shipped lines."""
    line, orders, customer = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    symbol = F.concat_ws("-", "c_mktsegment", "c_nationkey") if fine else F.col("c_mktsegment")
    return (line.select("l_orderkey", "l_shipdate", "l_extendedprice")
            .join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(customer.select("c_custkey", "c_mktsegment", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
            .select(symbol.alias("symbol"), F.col("l_shipdate").cast("timestamp").alias("ts"),
                    F.col("l_extendedprice").alias("close")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("external_id"), F.col("label").cast("string").alias("subject"), "embedding")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("guid"), F.col("turn").cast("int").alias("seg_idx"),
        (F.col("turn") * 30).cast("double").alias("start"), F.col("role").alias("speaker"), "text")


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One episode per conversation; its first turn is the description."""
    first = table(spark, sf_dir, "conversations").filter("turn = 0")
    guid = F.col("conv_id")
    return first.select(
        guid.cast("string").alias("guid"), F.concat(F.lit("show "), guid % 5).alias("show"),
        (guid % 5).cast("int").alias("show_idx"), F.floor(guid / 5).cast("int").alias("feed_idx"),
        F.concat(F.lit("Episode "), guid).alias("title"),
        F.timestamp_seconds(F.lit(1704067200) + guid * 3600).alias("published"),
        F.when(guid % 7 != 0, F.concat(F.lit("https://audio.example/"), guid)).alias("audio_url"),
        F.when(guid % 3 != 0, F.concat(F.lit("https://text.example/"), guid)).alias("transcript_url"),
        F.col("text").alias("description"))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("client"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"))


def readings_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reading per subject and day, computed at the end of the day."""
    from opinara.operators.readings import subject_reading

    days = items_e(spark, sf_dir).withColumn("day", F.col("ts").cast("date"))
    return subject_reading(days, ["subject", "day"]).withColumn(
        "computed_at", F.to_timestamp(F.concat(F.col("day").cast("string"), F.lit(" 23:59:59")))).drop("day")


def responses_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scorer responses for every event: mostly good, some garbage, irrelevant or failed."""
    n = F.col("event_id")
    body = F.when(n % 50 == 0, "this is not json at all").otherwise(F.concat(
        F.lit('{"relevant": '), F.when(n % 40 == 0, "false").otherwise("true"), F.lit(', "score": '),
        F.when(n % 3 == 0, F.concat(F.lit('"'), F.col("score"), F.lit('"'))).otherwise(F.col("score").cast("string")),
        F.lit(', "rationale": "'), F.col("event_type"), F.lit('"}')))
    return items_e(spark, sf_dir).select(
        F.concat(F.lit("item-"), n).alias("custom_id"), F.when(n % 33 != 0, body).alias("body"),
        F.when(n % 33 == 0, "429").alias("error_class"), n.alias("event_id"), F.col("user_id"))
