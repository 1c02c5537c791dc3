"""Mood against price: returns, lead/lag pairs, correlations, pooled study.

Inputs are aggregated series (one row per subject and period), so the windows here run over
as many rows as the calendar has periods, whatever the size of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from opinara import config
from opinara.functions.rounding import py_round

KINDS = {"coincident": 0, "lead": 1, "lag": -1}


# --- returns -----------------------------------------------------------------------------
def price_returns(prices: DataFrame) -> DataFrame:
    """Return against the previous *price row* of the symbol; null for the first or after a 0."""
    rows = Window.partitionBy("symbol").orderBy("period")
    previous = F.lag("close").over(rows)
    return (prices.withColumn("_prev", previous)
            .withColumn("ret", F.try_divide(F.col("close") - F.col("_prev"), F.col("_prev"))).drop("_prev"))


def joined_returns(conviction: DataFrame, prices: DataFrame) -> DataFrame:
    """Conviction and price on their common periods, with returns over the *joined* rows."""
    both = conviction.join(prices.withColumnRenamed("symbol", "subject"), ["subject", "period"])
    rows = Window.partitionBy("subject").orderBy("period")
    previous = F.lag("close").over(rows)
    return (both.withColumn("_prev", previous)
            .select("subject", "period", F.col("consensus").alias("conviction"), "close",
                    F.try_divide(F.col("close") - F.col("_prev"), F.col("_prev")).alias("ret")))


def next_period_return(prices: DataFrame, by: str = "symbol", order: str = "period") -> DataFrame:
    """Return from this row to the next, stamped on this row."""
    rows = Window.partitionBy(by).orderBy(order)
    return prices.withColumn("ret", F.try_divide(F.lead("close").over(rows), F.col("close")) - 1)


def conviction_with_returns(conviction: DataFrame, prices: DataFrame) -> DataFrame:
    """Every conviction period with price and price-row return where there is one."""
    priced = price_returns(prices).withColumnRenamed("symbol", "subject")
    return (conviction.join(priced, ["subject", "period"], "left")
            .select("subject", "period", F.col("consensus").alias("conviction"), "n", "close", "ret"))


def chart_axis(conviction: DataFrame, prices: DataFrame) -> DataFrame:
    """All periods either series has, with both values."""
    return conviction.join(prices.withColumnRenamed("symbol", "subject"), ["subject", "period"], "full_outer")


def period_union(conviction: DataFrame, prices: DataFrame) -> DataFrame:
    return (conviction.select("subject", "period")
            .union(prices.select(F.col("symbol").alias("subject"), "period")).distinct())


def period_intersection(conviction: DataFrame, prices: DataFrame) -> DataFrame:
    return (conviction.select("subject", "period")
            .intersect(prices.select(F.col("symbol").alias("subject"), "period")))


# --- pairing ---------------------------------------------------------------------------------
def _pairs(series: DataFrame, offsets: dict, name: str) -> DataFrame:
    rows = Window.partitionBy("subject").orderBy("period")
    options = []
    for label, shift in offsets.items():
        target = F.lead("ret", shift).over(rows) if shift >= 0 else F.lag("ret", -shift).over(rows)
        options.append(F.struct(F.lit(label).alias(name), target.alias("y")))
    return (series.select("subject", "period", F.col("conviction").alias("x"), F.array(*options).alias("_o"))
            .select("subject", "period", "x", F.inline("_o"))
            .filter(F.col("x").isNotNull() & F.col("y").isNotNull()))


def lead_lag_pairs(series: DataFrame) -> DataFrame:
    """``(subject, period, x, kind, y)``: conviction against the return at a positional offset.

    Offsets count observed periods, so a gap in the series is bridged.
    """
    return _pairs(series, KINDS, "kind")


def horizon_pairs(series: DataFrame, horizons: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    return _pairs(series, {h: h for h in horizons}, "horizon")


# --- correlation --------------------------------------------------------------------------------
def pearson(x: str = "x", y: str = "y") -> Column:
    """Aggregate expression: r, or null below three pairs or without variance."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    xs, ys = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.when(F.count(F.when(both, F.lit(1))) >= 3,
                  F.try_divide(F.covar_pop(xs, ys), F.stddev_pop(xs) * F.stddev_pop(ys)))


def t_statistic(r: Column | str, n: Column | str) -> Column:
    r = F.col(r) if isinstance(r, str) else r
    n = F.col(n) if isinstance(n, str) else n
    return (F.when(r.isNull(), F.lit(None).cast("double"))
            .when((F.abs(r) >= 1) | (n < 3), F.lit(float("inf")))
            .otherwise(r * F.sqrt((n - 2) / (1 - r * r))))


def is_significant(t: Column | str) -> Column:
    return F.abs(F.col(t) if isinstance(t, str) else t) > 2


def moments(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Per group: n, and the centred sums sxx, syy, sxy."""
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (F.var_pop("x") * F.count(F.lit(1))).alias("sxx"),
        (F.var_pop("y") * F.count(F.lit(1))).alias("syy"),
        (F.covar_pop("x", "y") * F.count(F.lit(1))).alias("sxy"))


def pooled_r(sxx: Column, syy: Column, sxy: Column, n: Column) -> Column:
    return F.when(n >= 3, F.try_divide(sxy, F.sqrt(sxx) * F.sqrt(syy)))


def pooled_correlation(pairs: DataFrame, by: list[str] | str = "kind") -> DataFrame:
    """Pooled r over subjects with at least three pairs, demeaned within subject.

    Demeaned pools have mean zero, so r only needs the sums of the subjects' centred moments:
    no pair leaves its subject.
    """
    by = [by] if isinstance(by, str) else list(by)
    per_subject = moments(pairs, by + ["subject"]).filter("n >= 3")
    pooled = per_subject.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("sxx").alias("sxx"), F.sum("syy").alias("syy"),
        F.sum("sxy").alias("sxy"), F.count(F.lit(1)).alias("subjects"))
    return (pooled.withColumn("r", pooled_r(F.col("sxx"), F.col("syy"), F.col("sxy"), F.col("n")))
            .withColumn("t", t_statistic("r", "n")).withColumn("significant", is_significant("t"))
            .select(*by, "r", "n", "t", "significant", "subjects"))


def demeaned(pairs: DataFrame, by: list[str]) -> DataFrame:
    within = Window.partitionBy(*by)
    return (pairs.withColumn("x", F.col("x") - F.avg("x").over(within))
            .withColumn("y", F.col("y") - F.avg("y").over(within)))


def subject_correlations(pairs: DataFrame, by: list[str] | str = ("kind", "subject")) -> DataFrame:
    return pairs.groupBy(*by).agg(pearson().alias("r"), F.count(F.lit(1)).alias("n"))


def lead_sign_summary(pairs: DataFrame) -> DataFrame:
    """How many subjects lead with a positive r, of how many, and their mean r."""
    lead = subject_correlations(pairs.filter("kind = 'lead'"), ["subject"]).filter("r is not null")
    return lead.agg(F.count_if(F.col("r") > 0).alias("positive"), F.count("r").alias("subjects"),
                    F.avg("r").alias("mean_r"))


def horizon_sweep(series: DataFrame, horizons: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    return pooled_correlation(horizon_pairs(series, horizons), "horizon")


# --- series and panels -----------------------------------------------------------------------------
def study_series(items_by_period: DataFrame, prices: DataFrame,
                 min_rows: int = config.STUDY_MIN_PERIODS) -> DataFrame:
    """Joined series of subjects with at least four readings and four joined rows."""
    subjects = Window.partitionBy("subject")
    enough = (items_by_period.withColumn("_n", F.count(F.lit(1)).over(subjects))
              .filter(F.col("_n") >= min_rows).drop("_n"))
    return (joined_returns(enough, prices).withColumn("_n", F.count(F.lit(1)).over(subjects))
            .filter(F.col("_n") >= min_rows).drop("_n"))


def backtest_panel(conviction: DataFrame, prices: DataFrame, period: str = "month",
                   min_periods: int = config.BACKTEST_MIN_PERIODS) -> DataFrame:
    """One ``backtest`` struct per subject: correlations, pair counts, note, aligned series.

    The aligned series of a subject is as long as the calendar, never as the corpus.
    """
    series = conviction_with_returns(conviction, prices)
    rows = Window.partitionBy("subject").orderBy("period")
    both = (series.withColumn("_lead", F.lead("ret").over(rows)).withColumn("_lag", F.lag("ret").over(rows)))
    known = lambda c: F.count(F.when(F.col(c).isNotNull() & F.col("conviction").isNotNull(), F.lit(1))).cast("int")
    agg = both.groupBy("subject").agg(
        F.count(F.lit(1)).cast("int").alias("n_periods"),
        pearson("conviction", "_lead").alias("_lead_r"), pearson("conviction", "ret").alias("_coin_r"),
        pearson("conviction", "_lag").alias("_lag_r"),
        known("_lead").alias("n_lead"), known("ret").alias("n_coincident"), known("_lag").alias("n_lag"),
        F.array_sort(F.collect_list(F.struct(
            "period", "conviction", F.col("close").alias("price"), py_round("ret", 4).alias("return")))).alias("_series"))
    enough = F.col("n_periods") >= min_periods
    note = (F.when(~enough, config.NOTE_TOO_FEW)
            .when(F.col("n_periods") < config.BACKTEST_THIN_PERIODS, config.NOTE_THIN)
            .otherwise(config.NOTE_PANEL))
    return agg.select("subject", F.struct(
        F.lit(period).alias("period"), F.col("n_periods"), F.when(enough, F.col("subject")).alias("proxy"),
        F.when(enough, py_round("_lead_r", 3)).alias("lead_r"),
        F.when(enough, py_round("_coin_r", 3)).alias("coincident_r"),
        F.when(enough, py_round("_lag_r", 3)).alias("lag_r"),
        F.when(enough, F.create_map(F.lit("lead"), F.col("n_lead"), F.lit("coincident"), F.col("n_coincident"),
                                    F.lit("lag"), F.col("n_lag"))).alias("n_pairs"),
        note.alias("note"),
        F.when(enough, F.col("_series")).otherwise(F.slice("_series", 1, 0)).alias("series")).alias("backtest"))


# --- signal evaluation ---------------------------------------------------------------------------------
def signal_evaluation(scores: DataFrame, returns: DataFrame, on: list[str], by: list[str] | None = None,
                      band: float = config.SIGNAL_BAND) -> DataFrame:
    """Daily score against the next return: hit rate, correlation, long/flat and hold returns."""
    score, ret = F.col("score"), F.col("ret")
    aligned = scores.join(returns, on).filter(score.isNotNull() & ret.isNotNull())
    call = F.abs(score) > band
    agg = aligned.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(call).alias("calls"),
        F.avg(F.when(call, ((score > 0) == (ret > 0)).cast("int"))).alias("hit_rate"),
        F.try_divide(F.covar_samp("score", "ret"), F.stddev_samp("score") * F.stddev_samp("ret")).alias("corr"),
        F.avg((ret > 0).cast("int")).alias("up_rate"),
        (F.product(1 + F.when(score > band, ret).otherwise(F.lit(0.0))) - 1).alias("strategy_return"),
        (F.product(1 + ret) - 1).alias("hold_return"))
    return agg.filter("n >= 2").withColumn("se", F.try_divide(F.lit(0.5), F.sqrt(F.col("calls").cast("double"))))


def signal_verdict(evaluation: DataFrame) -> DataFrame:
    """Adds ``edge`` over the better of coin flip and base rate, and a verdict word."""
    edge = F.col("hit_rate") - F.greatest(F.lit(0.5), F.col("up_rate"))
    return evaluation.withColumn("edge", edge).withColumn(
        "verdict",
        F.when(F.col("hit_rate").isNull() | (F.col("calls") < config.SIGNAL_MIN_CALLS), "too few calls")
        .when((F.abs("corr") < 0.05) & (F.abs("edge") < F.col("se")), "no edge")
        .when(F.col("edge") > F.col("se"), "possible edge").otherwise("ambiguous"))
