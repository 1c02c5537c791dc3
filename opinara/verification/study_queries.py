"""Prices, pairing, correlation, resampling and signal evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara import adapters as A
from opinara.functions.rounding import py_round
from opinara.operators import readings as R
from opinara.operators import significance as G
from opinara.operators import study as W
from opinara.plans.study import breadth_study
from opinara.sources.tables import price_series
from opinara.verification.reading_queries import _PANEL
from opinara.verification.registry import query
from opinara.verification.sql_views import py_round as R_, sql

ITERS = 500


def _months(spark, d):
    return R.period_readings(A.items_o(spark, d))


def _prices(spark, d, fine=False):
    return price_series(A.bars(spark, d, fine))


def _series(spark, d):
    return W.study_series(R.period_readings(A.items_n(spark, d)), _prices(spark, d, True))


def _pairs(spark, d):
    return W.lead_lag_pairs(_series(spark, d))


def _lead(spark, d):
    return _pairs(spark, d).filter("kind = 'lead'")


# --- S10, J1..J4, U2, U3, W1, W2, W6 ------------------------------------------------------------
@query("s10_price_series_month", sql("prices", "SELECT symbol, period, close FROM prices"))
def s10(spark, d):
    return _prices(spark, d)


@query("s10_price_series_week", sql("bars", """
SELECT symbol, strftime(date_trunc('week', ts), '%Y-%m-%d') AS period, arg_max(close, (ts, close)) AS close FROM bars GROUP BY 1, 2"""))
def s10_week(spark, d):
    return price_series(A.bars(spark, d), "week")


@query("w1_price_row_returns", sql("priced", f"SELECT subject AS symbol, period, {R_('ret', 6)} AS ret FROM priced"))
def w1(spark, d):
    return W.price_returns(_prices(spark, d)).select("symbol", "period", py_round("ret", 6).alias("ret"))


@query("w2_joined_row_returns", sql(("months", "prices"), f""",
j AS (SELECT subject, period, consensus AS conviction, close, (close - lag(close) OVER w) / nullif(lag(close) OVER w, 0) AS ret
      FROM months JOIN prices p USING (period) WHERE p.symbol = subject AND right(period, 2) <> '06' WINDOW w AS (PARTITION BY subject ORDER BY period))
SELECT subject, period, conviction, {R_('ret', 6)} AS ret FROM j"""))
def w2(spark, d):
    gappy = _months(spark, d).filter("not endswith(period, '06')")
    return W.joined_returns(gappy, _prices(spark, d)).select("subject", "period", "conviction", py_round("ret", 6).alias("ret"))


@query("w6_next_period_returns", sql("prices", f""",
r AS (SELECT symbol, period, lead(close) OVER (PARTITION BY symbol ORDER BY period) / close - 1 AS ret FROM prices)
SELECT symbol, period, {R_('ret', 6)} AS ret FROM r"""))
def w6(spark, d):
    return W.next_period_return(_prices(spark, d)).select("symbol", "period", py_round("ret", 6).alias("ret"))


@query("j1_conviction_with_returns", sql("aligned", f"SELECT subject, period, conviction, n, close, {R_('ret', 6)} AS ret FROM aligned"))
def j1(spark, d):
    return W.conviction_with_returns(_months(spark, d), _prices(spark, d)).withColumn("ret", py_round("ret", 6))


@query("j2_joined_series", sql(("months", "prices"), """
SELECT subject, period, consensus AS conviction, close FROM months JOIN prices USING (period) WHERE symbol = subject"""))
def j2(spark, d):
    return W.joined_returns(_months(spark, d), _prices(spark, d)).drop("ret")


@query("j4_chart_axis", sql(("months", "prices"), """
SELECT coalesce(m.subject, p.symbol) AS subject, coalesce(m.period, p.period) AS period, consensus, n, close
FROM months m FULL JOIN prices p ON m.subject = p.symbol AND m.period = p.period"""))
def j4(spark, d):
    return W.chart_axis(_months(spark, d), _prices(spark, d))


@query("u2_common_periods", sql(("months", "prices"), "SELECT subject, period FROM months INTERSECT SELECT symbol, period FROM prices"))
def u2(spark, d):
    return W.period_intersection(_months(spark, d), _prices(spark, d))


@query("u3_all_periods", sql(("months", "prices"), "SELECT subject, period FROM months UNION SELECT symbol, period FROM prices"))
def u3(spark, d):
    return W.period_union(_months(spark, d), _prices(spark, d))


# --- W3, W4, W5, W7 -----------------------------------------------------------------------------------
@query("w3_lead_lag_pairs", sql("pairs_n", f"SELECT subject, period, x, kind, {R_('y', 6)} AS y FROM pairs_n"))
def w3(spark, d):
    return _pairs(spark, d).withColumn("y", py_round("y", 6))


@query("w4_backtest_panel", sql("aligned", _PANEL + f"""
SELECT subject, n_periods, {R_('l', 3)} AS lead_r, {R_('k', 3)} AS coincident_r, {R_('g', 3)} AS lag_r, n_lead, n_coincident, n_lag,
       CASE WHEN n_periods < 3 THEN 'too few periods to backtest (need >= 3)' WHEN n_periods < 6 THEN 'thin — interpret with caution'
            ELSE 'did the informed crowd''s mood lead, track, or lag the price?' END AS note, n_periods AS series_length FROM c"""))
def w4(spark, d):
    b = W.backtest_panel(_months(spark, d), _prices(spark, d)).select("subject", "backtest.*")
    pairs = [F.col("n_pairs")[k].cast("bigint").alias(f"n_{k}") for k in ("lead", "coincident", "lag")]
    return b.select("subject", F.col("n_periods").cast("bigint").alias("n_periods"), "lead_r", "coincident_r", "lag_r", *pairs, "note",
                    F.size("series").cast("bigint").alias("series_length"))


@query("w4_aligned_series", sql("aligned", f"SELECT subject, period, conviction, close AS price, {R_('ret', 4)} AS \"return\" FROM aligned"))
def w4_series(spark, d):
    return W.backtest_panel(_months(spark, d), _prices(spark, d)).select("subject", F.inline("backtest.series"))


@query("w5_study_series", sql("series_n", f"SELECT subject, period, conviction, {R_('ret', 6)} AS ret FROM series_n"))
def w5(spark, d):
    return _series(spark, d).select("subject", "period", "conviction", py_round("ret", 6).alias("ret"))


@query("w7_demeaned_pairs", sql("pairs_n", f""",
d AS (SELECT subject, period, kind, x - avg(x) OVER w AS dx, y - avg(y) OVER w AS dy FROM pairs_n WINDOW w AS (PARTITION BY kind, subject))
SELECT subject, period, kind, {R_('dx', 6)} AS x, {R_('dy', 6)} AS y FROM d"""))
def w7(spark, d):
    return W.demeaned(_pairs(spark, d), ["kind", "subject"]).withColumn("x", py_round("x", 6)).withColumn("y", py_round("y", 6))


# --- A16..A19, A22 ----------------------------------------------------------------------------------------
@query("a16_pearson_per_subject", sql("pairs_n", f""",
r AS (SELECT kind, subject, count(*) AS n, CASE WHEN count(*) >= 3 THEN covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) END AS v FROM pairs_n GROUP BY 1, 2)
SELECT kind, subject, n, {R_('v', 6)} AS r FROM r"""))
def a16(spark, d):
    return W.subject_correlations(_pairs(spark, d)).withColumn("r", py_round("r", 6))


_POOL = """,
p AS (SELECT kind, sum(n) AS n, count(*) AS subjects, sum(sxy) / nullif(sqrt(sum(sxx)) * sqrt(sum(syy)), 0) AS v FROM moments_n GROUP BY 1),
q AS (SELECT *, CASE WHEN abs(v) >= 1 OR n < 3 THEN CAST('inf' AS DOUBLE) ELSE v * sqrt((n - 2) / (1 - v * v)) END AS tv FROM p)
"""


@query("a17_a18_pooled_correlation", sql("moments_n", _POOL + f"""
SELECT kind, CAST(n AS BIGINT) AS n, subjects, {R_('v', 6)} AS r, {R_('tv', 4)} AS t, abs(tv) > 2 AS significant FROM q"""))
def a18(spark, d):
    return W.pooled_correlation(_pairs(spark, d)).withColumn("r", py_round("r", 6)).withColumn("t", py_round("t", 4))


@query("a19_lead_sign_summary", sql("pairs_n", f""",
r AS (SELECT subject, CASE WHEN count(*) >= 3 THEN covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) END AS v FROM pairs_n WHERE kind = 'lead' GROUP BY 1),
s AS (SELECT count(*) FILTER (v > 0) AS positive, count(v) AS subjects, avg(v) AS m FROM r)
SELECT positive, subjects, {R_('m', 6)} AS mean_r FROM s"""))
def a19(spark, d):
    return W.lead_sign_summary(_pairs(spark, d)).withColumn("mean_r", py_round("mean_r", 6))


@query("a22_horizon_sweep", sql("series_n", f""",
h AS (SELECT subject, conviction AS x, unnest([0, 1, 2]) AS horizon, unnest([ret, lead(ret, 1) OVER w, lead(ret, 2) OVER w]) AS y
      FROM series_n WINDOW w AS (PARTITION BY subject ORDER BY period)),
m AS (SELECT horizon, subject, count(*) AS n, var_pop(x) * count(*) AS sxx, var_pop(y) * count(*) AS syy, covar_pop(x, y) * count(*) AS sxy
      FROM h WHERE y IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3),
p AS (SELECT horizon, CAST(sum(n) AS BIGINT) AS n, sum(sxy) / nullif(sqrt(sum(sxx)) * sqrt(sum(syy)), 0) AS v FROM m GROUP BY 1)
SELECT horizon, n, {R_('v', 6)} AS r FROM p"""))
def a22(spark, d):
    return W.horizon_sweep(_series(spark, d)).select("horizon", "n", py_round("r", 6).alias("r"))


# --- A20, A21 ------------------------------------------------------------------------------------------------
@query("a20_permutation_test", sql("pairs_n", f""",
l AS (SELECT subject, x, y, row_number() OVER (PARTITION BY subject ORDER BY period) - 1 AS i, count(*) OVER (PARTITION BY subject) AS k FROM pairs_n WHERE kind = 'lead'),
c AS (SELECT subject, i, x - avg(x) OVER (PARTITION BY subject) AS dx, y - avg(y) OVER (PARTITION BY subject) AS dy FROM l WHERE k >= 3),
o AS (SELECT sum(dx * dy) AS sxy, sqrt(sum(dx * dx)) * sqrt(sum(dy * dy)) AS s FROM c),
s AS (SELECT it, subject, dy, row_number() OVER (PARTITION BY it, subject ORDER BY md5('42:' || it || ':' || subject || ':' || i)) - 1 AS i FROM c, range({ITERS}) r(it)),
n AS (SELECT it, sum(c.dx * s.dy) AS sxy FROM s JOIN c USING (subject, i) GROUP BY 1),
z AS (SELECT count(*) FILTER (abs(n.sxy / o.s) >= abs(o.sxy / o.s)) AS hits, any_value(o.sxy / o.s) AS v FROM n, o)
SELECT {R_('v', 6)} AS r, {ITERS} AS iters, hits, (hits + 1) / {ITERS + 1}e0 AS p FROM z"""))
def a20(spark, d):
    return G.permutation_test(_lead(spark, d), ITERS, blocks=32, method="digest").withColumn("r", py_round("r", 6))


@query("a20_permutation_test_generator")
def a20_generator(spark, d):
    return G.permutation_test(_lead(spark, d), 5000, blocks=50).withColumn("r", py_round("r", 6))


@query("a21_bootstrap_interval")
def a21(spark, d):
    out = G.bootstrap_ci(spark, _lead(spark, d), ITERS)
    return out.select(py_round("ci_low", 6).alias("ci_low"), py_round("ci_high", 6).alias("ci_high"), "iters")


@query("a21_bootstrap_interval_named_order", sql("moments_n", f""",
m AS (SELECT *, row_number() OVER (ORDER BY subject) - 1 AS idx FROM moments_n WHERE kind = 'lead'),
k AS (SELECT count(*) AS k FROM m),
w AS (SELECT it, CAST('0x' || substr(md5('42:' || it || ':' || sl), 1, 12) AS BIGINT) % k AS idx FROM range({ITERS}) a(it), k, LATERAL (SELECT unnest(range(k)) AS sl)),
b AS (SELECT it, sum(sxy) / nullif(sqrt(sum(sxx)) * sqrt(sum(syy)), 0) AS r FROM w JOIN m USING (idx) GROUP BY 1),
s AS (SELECT list_sort(list(r)) AS rs FROM b WHERE r IS NOT NULL),
e AS (SELECT rs[CAST(floor(0.025e0 * len(rs)) AS INTEGER) + 1] AS lo, rs[CAST(floor(0.975e0 * len(rs)) AS INTEGER) + 1] AS hi FROM s)
SELECT {R_('lo', 6)} AS ci_low, {R_('hi', 6)} AS ci_high FROM e"""))
def a21_named(spark, d):
    """Numbers subjects in name order (a handful of groups here) so that SQL draws the same ones."""
    from pyspark.sql import Window

    per = W.moments(_lead(spark, d), ["subject"]).filter("n >= 3")
    indexed = per.withColumn("idx", (F.row_number().over(Window.orderBy("subject")) - 1).cast("bigint"))
    out = G.bootstrap_ci(spark, _lead(spark, d), ITERS, indexed=indexed)
    return out.select(py_round("ci_low", 6).alias("ci_low"), py_round("ci_high", 6).alias("ci_high"))


@query("a21_tree_draws", sql("moments_n", f""",
m AS (SELECT count(*) AS drawn FROM moments_n WHERE kind = 'lead')
SELECT it AS iter, drawn FROM range({ITERS}) r(it), m"""))
def a21_draws(spark, d):
    """The counts that the tree hands to all subjects of an iteration add up to the number of subjects."""
    per = W.moments(_lead(spark, d), ["subject"]).filter("n >= 3").select("subject", F.lit(1.0).alias("n"), "sxx", "syy", "sxy")
    return G.drawn_sums(per, ITERS).select("iter", F.col("n").cast("bigint").alias("drawn"))


# --- A23, A24, J3 ----------------------------------------------------------------------------------------------------
_EVAL = """,
s AS (SELECT subject, period, consensus / 100e0 AS score FROM months),
r AS (SELECT symbol AS subject, period, lead(close) OVER (PARTITION BY symbol ORDER BY period) / close - 1 AS ret FROM prices),
j AS (SELECT * FROM s JOIN r USING (subject, period) WHERE score IS NOT NULL AND ret IS NOT NULL),
e AS (SELECT subject, count(*) AS n, count(*) FILTER (abs(score) > 0.05) AS calls,
      avg(CASE WHEN abs(score) > 0.05 THEN CASE WHEN (score > 0) = (ret > 0) THEN 1 ELSE 0 END END) AS h,
      covar_samp(score, ret) / nullif(stddev_samp(score) * stddev_samp(ret), 0) AS c, avg(CASE WHEN ret > 0 THEN 1 ELSE 0 END) AS u,
      product(1 + CASE WHEN score > 0.05 THEN ret ELSE 0 END) - 1 AS st, product(1 + ret) - 1 AS ho FROM j GROUP BY 1 HAVING count(*) >= 2),
f AS (SELECT *, 0.5e0 / sqrt(nullif(calls, 0)) AS se, h - greatest(0.5e0, u) AS edge FROM e)
"""


def _evaluation(spark, d):
    scores = _months(spark, d).select("subject", "period", (F.col("consensus") / 100.0).alias("score"))
    returns = W.next_period_return(_prices(spark, d)).select(F.col("symbol").alias("subject"), "period", "ret")
    return W.signal_evaluation(scores, returns, ["subject", "period"], ["subject"])


@query("a23_signal_evaluation", sql(("months", "prices"), _EVAL + f"""
SELECT subject, n, calls, {R_('h', 6)} AS hit_rate, {R_('c', 6)} AS corr, {R_('u', 6)} AS up_rate, {R_('st', 4)} AS strategy_return,
       {R_('ho', 4)} AS hold_return, {R_('se', 6)} AS se FROM f"""))
def a23(spark, d):
    e = _evaluation(spark, d)
    six = [py_round(c, 6).alias(c) for c in ("hit_rate", "corr", "up_rate", "se")]
    return e.select("subject", "n", "calls", *six, py_round("strategy_return", 4).alias("strategy_return"), py_round("hold_return", 4).alias("hold_return"))


@query("a24_signal_verdict", sql(("months", "prices"), _EVAL + f"""
SELECT subject, {R_('edge', 6)} AS edge, CASE WHEN h IS NULL OR calls < 20 THEN 'too few calls' WHEN abs(c) < 0.05 AND abs(edge) < se THEN 'no edge'
       WHEN edge > se THEN 'possible edge' ELSE 'ambiguous' END AS verdict FROM f"""))
def a24(spark, d):
    return W.signal_verdict(_evaluation(spark, d)).select("subject", py_round("edge", 6).alias("edge"), "verdict")


@query("j3_signal_with_next_return", sql(("months", "prices"), f""",
r AS (SELECT symbol AS subject, period, lead(close) OVER (PARTITION BY symbol ORDER BY period) / close - 1 AS ret FROM prices)
SELECT subject, period, consensus, {R_('ret', 6)} AS ret FROM months JOIN r USING (subject, period) WHERE ret IS NOT NULL"""))
def j3(spark, d):
    returns = W.next_period_return(_prices(spark, d)).select(F.col("symbol").alias("subject"), "period", "ret")
    joined = _months(spark, d).join(returns, ["subject", "period"]).dropna(subset=["consensus", "ret"])
    return joined.select("subject", "period", "consensus", py_round("ret", 6).alias("ret"))


_WEEK = f""",
wr AS (SELECT subject, strftime(date_trunc('week', ts), '%Y-%m-%d') AS period, avg(score) AS m FROM items_o GROUP BY 1, 2 HAVING count(*) >= 3),
wm AS (SELECT subject, period, {R_('m', 1)} AS consensus FROM wr),
wp AS (SELECT symbol, strftime(date_trunc('week', ts), '%Y-%m-%d') AS period, arg_max(close, (ts, close)) AS close FROM bars GROUP BY 1, 2),
wj AS (SELECT m.subject, m.period, consensus AS conviction, close FROM (SELECT *, count(*) OVER (PARTITION BY subject) AS k FROM wm) m
       JOIN wp ON m.subject = wp.symbol AND m.period = wp.period WHERE k >= 4),
ws AS (SELECT * FROM (SELECT subject, period, conviction, (close - lag(close) OVER w) / nullif(lag(close) OVER w, 0) AS ret, count(*) OVER (PARTITION BY subject) AS k
       FROM wj WINDOW w AS (PARTITION BY subject ORDER BY period)) WHERE k >= 4),
wq AS (SELECT subject, conviction AS x, kind, y FROM (SELECT subject, conviction, ret AS coincident, lead(ret) OVER w AS "lead", lag(ret) OVER w AS "lag"
       FROM ws WINDOW w AS (PARTITION BY subject ORDER BY period)) UNPIVOT (y FOR kind IN (coincident, "lead", "lag")) WHERE y IS NOT NULL),
moments_n AS (SELECT kind, subject, count(*) AS n, var_pop(x) * count(*) AS sxx, var_pop(y) * count(*) AS syy, covar_pop(x, y) * count(*) AS sxy
       FROM wq GROUP BY 1, 2 HAVING count(*) >= 3)
"""


@query("study_pooled_week", sql(("items_o", "bars"), _WEEK + _POOL + f"""
SELECT kind, CAST(n AS BIGINT) AS n, subjects, {R_('v', 6)} AS r, {R_('tv', 4)} AS t, abs(tv) > 2 AS significant FROM q"""))
def study_week(spark, d):
    study = breadth_study(A.items_o(spark, d), price_series(A.bars(spark, d), "week"), "week")
    return study["pooled"].withColumn("r", py_round("r", 6)).withColumn("t", py_round("t", 4))
