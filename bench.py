"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the tables and the local cores.  Each query runs
once to warm up and then twice; the better time counts.  Results are written to the no-op
sink, so every row is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from opinara.session import local_session  # noqa: E402
from opinara.verification import registry  # noqa: E402

HEADLINE = [
    "flagship_readings", "a1_subject_reading", "a2_period_readings_month", "t3_balanced_citations",
    "daily_rows_complete", "a8_ticker_consensus", "a14_first_wins_by_text", "j5_drop_known_items", "s11_item_sink",
    "w4_backtest_panel", "a17_a18_pooled_correlation", "a22_horizon_sweep", "a20_permutation_test_generator",
    "a21_bootstrap_interval", "a23_signal_evaluation", "t1_cosine_top_k", "t1_cosine_top_k_per_subject",
    "t2_inverted_file_search", "j9_mention_counts", "j9_mention_counts_documents", "w9_passage_records",
    "p15_parsed_responses", "s4_search_hits", "f1_strip_html", "st1_sliding_window_limiter", "st2_daily_budget",
    "v5_answer_requests", "st4_weekly_readings_stream",
]


def run(spark, fn, sf_dir: str) -> float:
    start = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    registry.load_all()
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        fn = registry.QUERIES[name]
        run(spark, fn, sf_dir)
        times[name] = round(min(run(spark, fn, sf_dir) for _ in range(2)), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
