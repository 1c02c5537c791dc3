from __future__ import annotations

import math
import random

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from opinara.operators import significance as G
from opinara.operators import study as W

PAIRS = "subject string, period string, x double, y double"


def pairs(spark, n_subjects=12, seed=0, slope=0.0):
    rng = random.Random(seed)
    data = []
    for s in range(n_subjects):
        for p in range(rng.randint(3, 30)):
            x = rng.gauss(s, 1)
            data.append((f"s{s}", f"{p:03d}", x, slope * x + rng.gauss(-s, 1)))
    return spark.createDataFrame(data, PAIRS), data


def brute_pooled(data):
    xs, ys = [], []
    for s in sorted({d[0] for d in data}):
        x = np.array([d[2] for d in data if d[0] == s])
        y = np.array([d[3] for d in data if d[0] == s])
        if len(x) >= 3:
            xs.extend(x - x.mean())
            ys.extend(y - y.mean())
    return float(np.corrcoef(xs, ys)[0, 1]), len(xs)


def test_pooled_correlation(spark):
    df, data = pairs(spark, slope=0.4)
    out = W.pooled_correlation(df.withColumn("kind", F.lit("lead"))).first()
    r, n = brute_pooled(data)
    assert out.n == n and abs(out.r - r) < 1e-12
    assert abs(out.t - r * math.sqrt((n - 2) / (1 - r * r))) < 1e-9 and out.significant


def test_correlation_edge_cases(spark):
    df = spark.createDataFrame([("flat", "1", 1.0, 1.0), ("flat", "2", 1.0, 2.0), ("flat", "3", 1.0, 3.0), ("two", "1", 1.0, 2.0), ("two", "2", 2.0, 1.0),
                                ("line", "1", 1.0, 1.0), ("line", "2", 2.0, 2.0), ("line", "3", 3.0, 3.0)], PAIRS)
    got = {r.subject: r.r for r in W.subject_correlations(df, ["subject"]).collect()}
    assert got["flat"] is None and got["two"] is None and abs(got["line"] - 1) < 1e-12
    t = spark.createDataFrame([(1.0, 5), (0.5, 2), (0.5, 6), (None, 9)], "r double, n int").select(W.t_statistic("r", "n")).collect()
    assert t[0][0] == math.inf and t[1][0] == math.inf and abs(t[2][0] - 0.5 * math.sqrt(4 / 0.75)) < 1e-12 and t[3][0] is None


def test_lead_lag_is_positional_and_bridges_gaps(spark):
    series = spark.createDataFrame([("S", "2024-01", 1.0, None), ("S", "2024-02", 2.0, 0.2), ("S", "2024-05", 3.0, 0.5)],
                                   "subject string, period string, conviction double, ret double")
    assert rows(W.lead_lag_pairs(series), "kind", "period", "y") == [
        ("coincident", "2024-02", 0.2), ("coincident", "2024-05", 0.5), ("lag", "2024-05", 0.2), ("lead", "2024-01", 0.2), ("lead", "2024-02", 0.5)]


def test_price_row_returns_and_joined_returns_differ_at_gaps(spark):
    prices = spark.createDataFrame([("S", "1", 10.0), ("S", "2", 0.0), ("S", "3", 5.0), ("S", "4", 6.0)], "symbol string, period string, close double")
    assert rows(W.price_returns(prices), "period", "ret") == [("1", None), ("2", -1.0), ("3", None), ("4", (6 - 5) / 5)]
    conviction = spark.createDataFrame([("S", "1", 3.0, 1), ("S", "4", 4.0, 1)], "subject string, period string, consensus double, n int")
    assert rows(W.joined_returns(conviction, prices), "period", "ret") == [("1", None), ("4", -0.4)]


def test_backtest_notes(spark):
    def panel(n):
        conviction = spark.createDataFrame([("S", f"2024-{m:02d}", float(m * m % 7), 1) for m in range(1, n + 1)], "subject string, period string, consensus double, n int")
        prices = spark.createDataFrame([("S", f"2024-{m:02d}", 10.0 + m % 5) for m in range(1, n + 1)], "symbol string, period string, close double")
        return W.backtest_panel(conviction, prices).first().backtest
    few, thin, full = panel(2), panel(5), panel(8)
    assert few.note.startswith("too few") and few.lead_r is None and few.series == []
    assert thin.note.startswith("thin") and thin.n_pairs == {"lead": 4, "coincident": 4, "lag": 3}
    assert full.n_periods == 8 and full.series[0]["return"] is None and len(full.series) == 8 and full.lead_r is not None


def test_permutation_finds_signal_and_not_noise(spark):
    signal, data = pairs(spark, slope=0.8)
    noise, _ = pairs(spark, seed=3)
    for method in ("generator", "digest"):
        s = G.permutation_test(signal, 200, blocks=8, method=method).first()
        assert abs(s.r - brute_pooled(data)[0]) < 1e-12 and s.p == 1 / 201
        assert G.permutation_test(noise, 200, blocks=8, method=method).first().p > 0.02
    again = G.permutation_test(signal.repartition(5), 200, blocks=8).first()
    assert again.p == 1 / 201
    assert G.permutation_test(noise.repartition(7), 200, blocks=8).first() == G.permutation_test(noise, 200, blocks=8).first()


def test_permutation_without_pairs(spark):
    out = G.permutation_test(spark.createDataFrame([("a", "1", 1.0, 2.0)], PAIRS), 10, blocks=2).first()
    assert (out.r, out.p) == (0.0, 1.0)


def test_bootstrap_brackets_the_estimate(spark):
    df, data = pairs(spark, n_subjects=25, slope=0.5)
    out = G.bootstrap_ci(spark, df, 300).first()
    assert out.ci_low < brute_pooled(data)[0] < out.ci_high and out.ci_low > 0 and out.iters == 300


def test_bootstrap_draws_every_slot(spark):
    draws = G.bootstrap_draws(spark, F.lit(7).cast("bigint"), 50)
    assert rows(draws.groupBy("iter").count().select("count").distinct()) == [(7,)]
    assert draws.agg(F.min("idx"), F.max("idx")).first() == (0, 6)


def test_bootstrap_counts_are_multinomial(spark):
    """Every iteration draws as many subjects as there are, each as often as a binomial says."""
    names, iters = [f"s{i}" for i in range(40)], 5_000
    subjects = spark.createDataFrame([(s, 1.0, float(i == 3), float(i == 7), float(i in (3, 7))) for i, s in enumerate(names)],
                                     "subject string, n double, sxx double, syy double, sxy double")
    out = G.drawn_sums(subjects, iters, 1).orderBy("iter").toPandas()
    assert list(out.iter) == list(range(iters)) and set(out.n) == {40.0}
    assert (out.sxy == out.sxx + out.syy).all()
    for c in ("sxx", "syy"):  # binomial(40, 1/40): mean 1, variance 39/40
        assert abs(out[c].mean() - 1) < 0.07 and abs(out[c].var() - 39 / 40) < 0.1
    assert abs(np.cov(out.sxx, out.syy)[0, 1] + 1 / 40) < 0.07
    assert abs((out.sxx == 0).mean() - (39 / 40) ** 40) < 0.03


def test_bootstrap_tree_over_many_leaves(spark):
    """Several leaves and chunks: counts still add up, and no number depends on the partitions."""
    n = 10_000
    subjects = spark.range(n).select(F.concat(F.lit("s"), F.col("id")).alias("subject"), F.lit(1.0).alias("n"),
                                     (F.col("id") < n // 4).cast("double").alias("sxx"), F.col("id").cast("double").alias("syy"),
                                     (F.col("id") % 2).cast("double").alias("sxy"))
    one, other = (G.drawn_sums(subjects.repartition(p), 200, 5).orderBy("iter").toPandas() for p in (1, 13))
    assert one.equals(other) and set(one.n) == {float(n)}
    for c, share in (("sxx", 0.25), ("sxy", 0.5)):
        assert abs(one[c].mean() - n * share) < 5 * (n * share * (1 - share) / 200) ** 0.5
        assert abs(one[c].std() / (n * share * (1 - share)) ** 0.5 - 1) < 0.25
    few = G.drawn_sums(subjects, 70, 5).orderBy("iter").toPandas()
    assert few.equals(one[:70])


def test_bootstrap_methods_agree(spark):
    df, _ = pairs(spark, n_subjects=25, slope=0.5)
    a, b = (G.bootstrap_ci(spark, df, 2000, method=m).first() for m in ("generator", "digest"))
    assert abs(a.ci_low - b.ci_low) < 0.03 and abs(a.ci_high - b.ci_high) < 0.03
    nothing = G.bootstrap_ci(spark, df.limit(0), 50).first()
    assert (nothing.ci_low, nothing.ci_high, nothing.iters) == (0.0, 0.0, 0)


def test_dense_index(spark):
    out = G.dense_index(spark.range(1000).select((F.col("id") * 3).cast("string").alias("k")), "k", 16)
    assert sorted(r.idx for r in out.collect()) == list(range(1000))


def test_signal_evaluation_against_pandas_rules(spark):
    rng = random.Random(6)
    data = [(f"d{i:03d}", rng.uniform(-0.3, 0.3), rng.uniform(-0.02, 0.02)) for i in range(60)]
    scores = spark.createDataFrame([(d, s) for d, s, _ in data], "day string, score double")
    returns = spark.createDataFrame([(d, r) for d, _, r in data], "day string, ret double")
    out = W.signal_verdict(W.signal_evaluation(scores, returns, ["day"])).first()
    s, r = np.array([d[1] for d in data]), np.array([d[2] for d in data])
    calls = np.abs(s) > 0.05
    assert out.calls == calls.sum() and abs(out.hit_rate - np.mean((s[calls] > 0) == (r[calls] > 0))) < 1e-12
    assert abs(out.corr - np.corrcoef(s, r)[0, 1]) < 1e-12 and abs(out.hold_return - (np.prod(1 + r) - 1)) < 1e-12
    assert abs(out.strategy_return - (np.prod(1 + np.where(s > 0.05, r, 0)) - 1)) < 1e-12
    assert out.verdict in ("no edge", "possible edge", "ambiguous")


def test_permutation_p_does_not_depend_on_the_spread(spark):
    import random

    rng = random.Random(1)
    pairs = spark.createDataFrame([(f"s{i % 3}", f"{i:03}", rng.random(), rng.random()) for i in range(60)], PAIRS)
    got = {G.permutation_test(pairs.repartition(n), 300, blocks=b).first().hits for n, b in ((1, 1), (4, 4), (7, 50), (3, None))}
    assert len(got) == 1
