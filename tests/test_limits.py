from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

from conftest import rows
from pyspark.sql import functions as F

from opinara.operators import limits as L

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def log(spark, hits):
    data = [(c, START + timedelta(seconds=s), i) for i, (c, s) in enumerate(hits)]
    return spark.createDataFrame(data, "client string, ts timestamp, seq bigint")


def brute(hits, limit, window):
    held, out = {}, {}
    for i, (client, s) in sorted(enumerate(hits), key=lambda h: (h[1][1], h[0])):
        mine = held.setdefault(client, [])
        mine[:] = [t for t in mine if t > s - window]
        if len(mine) < limit:
            mine.append(s)
            out[i] = (True, None)
        else:
            out[i] = (False, max(1.0, mine[0] + window - s))
    return out


def decide(spark, hits, limit, window):
    got = L.admit_requests(spark, log(spark, hits), limit, window).collect()
    return {r.seq: (r.admitted, None if r.retry_after is None else round(r.retry_after, 3)) for r in got}


def test_trips_after_the_limit_and_isolates_clients(spark):
    hits = [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 3), ("a", 3599), ("a", 3600)]
    got = decide(spark, hits, 3, 3600)
    assert [got[i][0] for i in range(7)] == [True, True, True, False, True, False, True]
    assert got[3][1] == 3597.0 and got[5][1] == 1.0


def test_zero_disables(spark):
    assert all(a for a, _ in decide(spark, [("a", 0)] * 5, 0, 60).values())


def test_against_brute_force_with_a_hammering_client(spark):
    rng = random.Random(2)
    hits = [("hot", rng.randint(0, 900)) for _ in range(1500)] + [(f"c{rng.randint(0, 20)}", rng.randint(0, 900)) for _ in range(400)]
    hits += [("edge", 100 * k) for k in range(10)] + [("edge", 100 * k) for k in range(10)]
    for limit, window in ((3, 100), (1, 60)):
        assert decide(spark, hits, limit, window) == brute(hits, limit, window)


def test_stream_agrees_with_batch(spark, tmp_path):
    from opinara.streaming.limiter import ROCKSDB, admit_stream

    rng = random.Random(4)
    hits = [(f"c{rng.randint(0, 3)}", s) for s in sorted(rng.randint(0, 2000) for _ in range(200))]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        for part in range(2):      # two micro-batches, in time order
            log(spark, hits).filter(F.floor(F.col("seq") / 100) == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("client string, ts timestamp, seq bigint").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = (admit_stream(stream, 2, 100).writeStream.format("parquet").option("path", f"{tmp_path}/out")
             .option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {r.seq: (r.admitted, None if r.retry_after is None else round(r.retry_after, 3)) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == brute(hits, 2, 100)


def test_daily_budget(spark):
    hits = [("x", 10 * i) for i in range(5)] + [("x", 86400 + i) for i in range(2)]
    got = {r.seq: (r.allowed, r.retry_after) for r in L.daily_budget(log(spark, hits), 3).collect()}
    assert [got[i][0] for i in range(7)] == [True, True, True, False, False, True, True]
    assert got[3][1] == 86400 - 30
    assert all(r.allowed for r in L.daily_budget(log(spark, hits), 0).collect())
    cases = spark.createDataFrame([(9, 10), (10, 10), (99, 10), (10000, 0)], "used int, budget int")
    assert [r[0] for r in cases.select(L.budget_allows("used", "budget")).collect()] == [True, False, False, True]


def test_requests_without_a_time_are_handed_back(spark):
    from opinara.operators.limits import daily_budget

    df = spark.createDataFrame([(1, None), (2, "2024-01-01 10:00:00")], "seq bigint, t string").select("seq", F.try_to_timestamp("t").alias("ts"))
    assert {r.seq: (r.allowed, r.retry_after) for r in daily_budget(df, 1).collect()} == {1: (False, None), 2: (True, None)}


def _jobs(spark, tag, fn):
    spark.sparkContext.setJobGroup(tag, tag)
    try:
        fn()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_clients_over_borders_calm_and_hammering(spark):
    rng = random.Random(7)
    hits = [("hammer", s) for s in sorted(rng.randint(0, 20_000) for _ in range(3000))]
    hits += [("polite", 40 * k + rng.randint(0, 9)) for k in range(1500)]                     # hot, never refused
    hits += [("bursts", 1000 * (k // 60) + rng.randint(0, 90)) for k in range(3000)]          # busy and calm in turn
    hits += [(f"c{i % 50}", rng.randint(0, 3000)) for i in range(500)] + [("z", 5)] * 40
    for limit, window in ((3, 100), (1, 30), (7, 500)):
        assert decide(spark, hits, limit, window) == brute(hits, limit, window)


def test_batches_of_any_size_decide_the_same(spark):
    rng = random.Random(8)
    hits = [(f"c{rng.randint(0, 4)}", rng.randint(0, 4000)) for _ in range(1500)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert decide(spark, hits, 3, 60) == brute(hits, 3, 60)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_jobs_do_not_grow_with_the_log(spark):
    hits = [("a", 3600 * h + k) for h in range(8760) for k in range(3)]
    df = log(spark, hits)
    got = []
    jobs = _jobs(spark, "limiter", lambda: got.extend(L.admit_requests(spark, df, 2, 3600).collect()))
    assert jobs <= 10
    want = brute(hits, 2, 3600)
    assert {r.seq: r.admitted for r in got} == {i: ok for i, (ok, _) in want.items()}


def test_requests_without_client_or_time_are_admitted(spark):
    rows_ = [(None, START, 1), (None, START, 2), ("a", None, 3), ("a", START, 4), ("a", START, 5)]
    got = L.admit_requests(spark, spark.createDataFrame(rows_, "client string, ts timestamp, seq bigint"), 1, 60).collect()
    assert {r.seq: (r.admitted, r.retry_after) for r in got} == {1: (True, None), 2: (True, None), 3: (True, None), 4: (True, None), 5: (False, 60.0)}
    assert L.admit_requests(spark, log(spark, []), 1, 60).count() == 0
