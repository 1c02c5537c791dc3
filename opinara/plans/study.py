"""The breadth study: does mood lead price, over many subjects?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from opinara import config
from opinara.operators.readings import period_readings
from opinara.operators.significance import bootstrap_ci, permutation_test
from opinara.operators.study import horizon_sweep, lead_lag_pairs, lead_sign_summary, pooled_correlation, study_series
from opinara.session import scratch_path


def breadth_study(items: DataFrame, prices: DataFrame, period: str = "month") -> dict[str, DataFrame]:
    """Pooled correlations per kind, the lead's sign count, and the horizon sweep."""
    series = study_series(period_readings(items, period, config.STUDY_MIN_ITEMS[period]), prices)
    pairs = lead_lag_pairs(series)
    return {"series": series, "pairs": pairs, "pooled": pooled_correlation(pairs),
            "lead_signs": lead_sign_summary(pairs), "horizons": horizon_sweep(series)}


def significance(spark: SparkSession, items: DataFrame, prices: DataFrame, period: str = "month",
                 iters: int = 5000, seed: int = 42) -> DataFrame:
    """Lead correlation with its permutation p and bootstrap interval, one row.

    The pairs are written once, so that thousands of iterations do not re-read the corpus.
    """
    study = breadth_study(items, prices, period)
    path = scratch_path(spark, "lead-pairs")
    study["pairs"].filter("kind = 'lead'").write.parquet(path)
    lead = spark.read.schema(study["pairs"].schema).parquet(path)
    p = permutation_test(lead, iters, seed).select("r", "p")
    ci = bootstrap_ci(spark, lead, iters, seed).select("ci_low", "ci_high")
    return (p.withColumn("_k", F.lit(1)).join(ci.withColumn("_k", F.lit(1)), "_k").drop("_k")
            .withColumn("significant", F.col("p") < 0.05)
            .withColumn("excludes_zero", (F.col("ci_low") > 0) | (F.col("ci_high") < 0)))


def export(study: dict[str, DataFrame], root: str) -> None:
    for name, frame in study.items():
        frame.write.mode("overwrite").json(f"{root}/{name}")
