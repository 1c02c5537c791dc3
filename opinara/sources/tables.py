"""Headline files, the subject dimension and price series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from opinara import schemas
from opinara.functions.rounding import py_round
from opinara.functions.scalars import bucket_key, bucket_start
from opinara.functions.text import clean_headline


# --- headlines -------------------------------------------------------------------------
def headlines_long(wide: DataFrame, year: int | str, max_days: int | None = None) -> DataFrame:
    """``Date, Top1..TopN`` to ``(run_date, position, headline)``; empty cells are dropped.

    ``max_days`` keeps the earliest rows of the year; it is a bounded top-k on the date.
    """
    tops = [c for c in wide.columns if c.startswith("Top")]
    days = wide.filter(F.col("Date").startswith(str(year))).select("Date", *tops)
    if max_days:
        days = days.orderBy("Date").limit(max_days)
    long = days.unpivot("Date", tops, "slot", "raw")
    return (long.select(F.col("Date").alias("run_date"),
                        F.array_position(F.array(*[F.lit(c) for c in tops]), F.col("slot")).cast("int").alias("position"),
                        clean_headline("raw").alias("headline"))
            .filter(F.col("headline") != ""))


def read_headlines(spark: SparkSession, path: str, year: int | str, max_days: int | None = None) -> DataFrame:
    wide = (spark.read.option("header", True).option("multiLine", True).option("quote", '"')
            .option("escape", '"').csv(path))
    return headlines_long(wide, year, max_days)


def headline_records(headlines: DataFrame) -> DataFrame:
    """Headlines as canonical news records stamped noon UTC of their day."""
    return headlines.select(
        F.lit("news-historical").alias("source"), F.lit(2).alias("source_tier"),
        F.col("headline").alias("title"), F.col("headline").alias("text"), F.lit("").alias("url"),
        F.to_timestamp(F.concat(F.col("run_date").cast("string"), F.lit(" 12:00:00"))).alias("ts"),
        F.lit(0).cast("bigint").alias("raw_engagement"), F.col("run_date").cast("string").alias("run_date"),
        "position")


# --- subject dimension ------------------------------------------------------------------
def parse_subjects(df: DataFrame, payload: str = "payload", order: str | None = None) -> DataFrame:
    """JSON maps ``key -> subject`` to rows, in map order (``seq``); ``order`` numbers the maps."""
    first = F.lit(0) if order is None else F.col(order)
    return (df.select(first.alias("_o"),
                      F.posexplode(F.map_entries(F.from_json(payload, schemas.SUBJECT_JSON))).alias("_p", "e"))
            .withColumn("seq", F.shiftleft(F.col("_o").cast("bigint"), 20) + F.col("_p"))
            .select(F.col("e.key").alias("input_key"), "e.value.display", "e.value.asset_type",
                    "e.value.is_financial", F.upper("e.value.proxy").alias("proxy"), "e.value.hn_query",
                    "e.value.reddit_query", "e.value.subreddits", "e.value.aliases", "e.value.input", "seq"))


def read_subjects(spark: SparkSession, path: str) -> DataFrame:
    return parse_subjects(spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload"))


def market_subjects(dim: DataFrame) -> DataFrame:
    """Priced market subjects only, one per proxy: the first in file order wins."""
    first = Window.partitionBy("proxy").orderBy("seq")
    return (dim.filter(F.col("is_financial") & (F.coalesce("proxy", F.lit("")) != ""))
            .withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn"))


# --- prices ---------------------------------------------------------------------------------
def price_series(bars: DataFrame, period: str = "month", ts: str = "ts", close: str = "close") -> DataFrame:
    """Last close per symbol and period, two decimals; bars of one instant give the highest close.

    One aggregate with map-side partials.  The period is grouped by its start and turned into
    text afterwards, once per period and not once per bar.
    """
    last = F.max(F.struct(F.col(ts).alias("t"), F.col(close).alias("c")))
    return (bars.filter(F.col(close).isNotNull()).groupBy("symbol", bucket_start(ts, period).alias("_start"))
            .agg(last.alias("_last"))
            .select("symbol", bucket_key("_start", period).alias("period"), py_round(F.col("_last.c"), 2).alias("close")))
