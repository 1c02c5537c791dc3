"""The historical test as one plan: headlines, requests, responses, daily scores, returns, verdict."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara import adapters as A
from opinara.functions.rounding import py_round
from opinara.plans import headlines as H
from opinara.sources import tables
from opinara.verification.registry import query
from opinara.verification.sql_views import py_round as R_, sql

YEAR = 1995


def _headlines(spark, d):
    """A headline table of orders: a row per day, one column per customer residue, some cells empty."""
    n = F.col("o_orderkey")
    text = F.concat(F.lit("b'order "), n, F.lit(" came in'"))
    tops = [F.max(F.when(F.col("o_custkey") % 5 == i, F.struct(n, text.alias("t")))).getField("t").alias(f"Top{i + 1}") for i in range(5)]
    wide = A.table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").cast("string").alias("Date")).agg(*tops)
    return tables.headlines_long(wide, YEAR)


def _responses(requests):
    """A scorer's answers: none for every 11th order, an unreadable one for every 13th, an error for every 97th."""
    n = F.regexp_extract("content", "TITLE: order ([0-9]+) ", 1).cast("long")
    answer = F.to_json(F.struct(((n % 41 - 20) / 20).alias("sentiment_score"), F.array(F.lit("AA")).alias("tickers"), F.array(F.lit("t")).alias("themes"),
                                F.array(F.lit("b")).alias("bull_signals"), F.array().cast("array<string>").alias("bear_signals")))
    failed = n % 97 == 0
    return requests.filter(n % 11 != 0).select(
        "custom_id", F.when(~failed, F.when(n % 13 == 0, "no idea").otherwise(answer)).alias("body"),
        F.when(failed, "RateLimitError").alias("error_class"))


def _closes(spark, d):
    return A.bars(spark, d).groupBy("symbol", F.col("ts").cast("date").cast("string").alias("run_date")).agg(F.max("close").alias("close"))


_SCORES = f""",
m AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS run_date, max(o_orderkey) AS e FROM orders WHERE year(o_orderdate) = {YEAR} GROUP BY 1, o_custkey % 5),
s AS (SELECT run_date, avg((e % 41 - 20) / 20e0) AS a FROM m WHERE e % 11 <> 0 AND e % 13 <> 0 AND e % 97 <> 0 GROUP BY 1),
scores AS (SELECT run_date, {R_('a', 4)} AS score FROM s)
"""


@query("headline_daily_scores", sql("bars", _SCORES + "SELECT run_date, score FROM scores"))
def scores(spark, d):
    headlines = _headlines(spark, d)
    return H.daily_scores(headlines, _responses(H.headline_requests(headlines)[1]))


@query("headline_test", sql("bars", _SCORES + f""",
c AS (SELECT symbol, strftime(ts, '%Y-%m-%d') AS run_date, max(close) AS close FROM bars GROUP BY 1, 2),
r AS (SELECT symbol, run_date, lead(close) OVER (PARTITION BY symbol ORDER BY run_date) / close - 1 AS ret FROM c),
j AS (SELECT * FROM scores JOIN r USING (run_date) WHERE ret IS NOT NULL),
e AS (SELECT symbol, count(*) AS n, count(*) FILTER (abs(score) > 0.05) AS calls,
      avg(CASE WHEN abs(score) > 0.05 THEN CASE WHEN (score > 0) = (ret > 0) THEN 1 ELSE 0 END END) AS h,
      covar_samp(score, ret) / nullif(stddev_samp(score) * stddev_samp(ret), 0) AS c, avg(CASE WHEN ret > 0 THEN 1 ELSE 0 END) AS u,
      sum(CASE WHEN score > 0.05 THEN ln(1 + ret) ELSE 0 END) AS st, sum(ln(1 + ret)) AS ho FROM j GROUP BY 1 HAVING count(*) >= 2),
f AS (SELECT *, 0.5e0 / sqrt(nullif(calls, 0)) AS se, h - greatest(0.5e0, u) AS edge FROM e)
SELECT symbol, n, calls, {R_('h', 6)} AS hit_rate, {R_('c', 6)} AS corr, {R_('u', 6)} AS up_rate, {R_('st', 6)} AS log_strategy, {R_('ho', 6)} AS log_hold,
       {R_('se', 6)} AS se, {R_('edge', 6)} AS edge, CASE WHEN h IS NULL OR calls < 20 THEN 'too few calls' WHEN abs(c) < 0.05 AND abs(edge) < se THEN 'no edge'
       WHEN edge > se THEN 'possible edge' ELSE 'ambiguous' END AS verdict FROM f"""))
def verdicts(spark, d):
    """Returns are compared by their logarithm, as those of a year of daily extremes span many magnitudes."""
    headlines = _headlines(spark, d)
    found = H.headline_test(headlines, _responses(H.headline_requests(headlines)[1]), _closes(spark, d))
    six = [py_round(c, 6).alias(c) for c in ("hit_rate", "corr", "up_rate", "se", "edge")]
    return found.select("symbol", "n", "calls", *six, py_round(F.log(F.col("strategy_return") + 1), 6).alias("log_strategy"),
                        py_round(F.log(F.col("hold_return") + 1), 6).alias("log_hold"), "verdict")
