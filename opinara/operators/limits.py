"""Admission control over request logs: sliding window per client, and a daily budget.

Both are exact for any client, and neither gathers a client's log.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from opinara import config
from opinara.session import scratch_path

_DECIDED = "client string, part int, us bigint, seq bigint, admitted boolean, retry_after double, held array<bigint>"


def walk(us: list[int], held: list[int], limit: int, width: int) -> list[tuple[int, int, int]]:
    """Refused stretches ``(from, to, free at)`` of ascending instants; all others are admitted.

    ``held`` has the last admissions and is brought up to date.  A request is refused while the
    admission ``limit`` places back is in the window; the end of that is found by bisection, so a
    stretch of refusals costs one step.
    """
    refused, i, n = [], 0, len(us)
    while i < n:
        free = held[-limit] + width if len(held) >= limit else us[i]
        if free <= us[i]:
            held.append(us[i])
            i += 1
        else:
            end = bisect_left(us, free, i)
            refused.append((i, end, free))
            i = end
        if len(held) > 4 * limit + 64:
            del held[:-limit]
    del held[:-limit]
    return refused


class _Part:
    """Decides the requests of a partition, sorted by client and time.

    All clients but the first begin here.  The first may go on from the partition before, so its
    requests stay open up to a cut: a request that is sure to be admitted, with all others of the window before
    it, whatever was admitted earlier.
    """

    def __init__(self, limit: int, width: int, first: bool):
        self.limit, self.width = limit, width
        self.client: str | None = None
        self.held: list[int] = []
        self.open = False
        self.may_be_open = not first
        self.recent: list[int] = []   # of an open client: its last requests, admitted or not
        self.began = self.unsure = 0  # its first instant here, and the last one whose request may be refused

    def decide(self, client: pa.Array, us: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which requests are open, which are admitted, and when a refused one could come back."""
        n = len(us)
        is_open, admitted, free = np.zeros(n, bool), np.ones(n, bool), np.zeros(n, np.int64)
        new = np.ones(n, bool)
        new[1:] = pc.not_equal(client.slice(1), client.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = client[0].as_py() != self.client
        starts = np.flatnonzero(new)
        # a client without a request in doubt needs no walk
        back = np.full(n, np.iinfo(np.int64).min)
        back[self.limit:] = us[:-self.limit] if n > self.limit else []
        runs = np.cumsum(new)
        same = np.zeros(n, bool)
        same[self.limit:] = runs[self.limit:] == runs[:-self.limit] if n > self.limit else []
        doubt = same & (back > us - self.width)
        doubtful = np.add.reduceat(doubt, starts) > 0 if len(starts) else []
        bounds = [*starts.tolist(), n]
        if not len(starts) or starts[0] > 0:
            self._go_on(us, 0, bounds[0], is_open, admitted, free)
        for k, start in enumerate(starts.tolist()):
            end = bounds[k + 1]
            last = end == n
            if self.may_be_open:
                self.client, self.held, self.recent, self.open = client[start].as_py(), [], [], True
                self.began = self.unsure = int(us[start])
                self.may_be_open = False
            elif doubtful[k] or last:
                self.client, self.held, self.open = client[start].as_py(), [], False
            else:
                continue
            self._go_on(us, start, end, is_open, admitted, free)
        return is_open, admitted, free

    def _go_on(self, us, start: int, end: int, is_open, admitted, free) -> None:
        if self.open:
            cut = self._cut(us[start:end])
            is_open[start:start + cut] = True
            start += cut
        if not self.open and start < end:
            for i, j, at in walk(us[start:end].tolist(), self.held, self.limit, self.width):
                admitted[start + i:start + j], free[start + i:start + j] = False, at

    def _cut(self, us: np.ndarray) -> int:
        """How many requests of the open client stay open; from a cut on what is held is known."""
        known = np.concatenate([np.array(self.recent, np.int64), us])
        r, n = len(self.recent), len(known)
        sure = known >= self.began + self.width
        if n > self.limit:
            sure[self.limit:] &= known[:-self.limit] <= known[self.limit:] - self.width
        doubts = np.where(sure, np.iinfo(np.int64).min, known)
        doubts[:r] = np.iinfo(np.int64).min
        last = np.maximum(np.maximum.accumulate(doubts), self.unsure)[r:]
        cuts = np.flatnonzero(us - self.width >= last)
        if not len(cuts):
            self.unsure, self.recent = int(last[-1]), known[-self.limit:].tolist()
            return len(us)
        at = int(cuts[0])
        self.open = False
        self.held = [t for t in known[max(0, r + at + 1 - self.limit):r + at + 1].tolist() if t > us[at] - self.width]
        return at + 1

    def tail(self) -> list[int] | None:
        """What the last client holds at the end, or nothing while it is open."""
        return None if self.open or self.client is None else self.held


def _decide_parts(limit: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        state, end = _Part(limit, width, part == 0), None
        for batch in batches:
            if not len(batch):
                continue
            client, us, seq = batch.columns
            instants = us.to_numpy()
            is_open, admitted, free = state.decide(client, instants)
            yield _decisions(client, part, us, seq, instants, is_open, admitted, free)
            end = client[len(client) - 1].as_py(), int(instants[-1])
        if end is not None and state.tail() is not None:
            # what the next partition has to know: sorts before its requests
            yield pa.RecordBatch.from_pylist([{"client": end[0], "part": part + 1, "held": state.tail()}], _SCHEMA)
    return run


_SCHEMA = pa.schema([("client", pa.string()), ("part", pa.int32()), ("us", pa.int64()), ("seq", pa.int64()), ("admitted", pa.bool_()),
                     ("retry_after", pa.float64()), ("held", pa.list_(pa.int64()))])


def _decisions(client, part, us, seq, instants, is_open, admitted, free) -> pa.RecordBatch:
    """Rows of decided requests; open ones have no decision yet."""
    n = len(instants)
    wait = np.maximum(1.0, (free - instants) / 1e6)
    parts = part if isinstance(part, pa.Array) else pa.array(np.full(n, part, np.int32))
    return pa.RecordBatch.from_arrays([client, parts, us, seq, pa.array(admitted, mask=is_open), pa.array(wait, mask=admitted | is_open),
                                       pa.nulls(n, pa.list_(pa.int64()))], schema=_SCHEMA)


def _decide_open(limit: int, width: int):
    """The open requests of all partitions, by client and partition, each after what the one before held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            client, part, us, seq, _, _, carried = batch.columns
            instants = us.fill_null(0).to_numpy()
            marks = np.flatnonzero(carried.is_valid().to_numpy(zero_copy_only=False))
            new = np.ones(n, bool)
            new[1:] = pc.not_equal(client.slice(1), client.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new[0] = client[0].as_py() != last
            admitted, free = np.ones(n, bool), np.zeros(n, np.int64)
            bounds = np.unique(np.concatenate([[0], np.flatnonzero(new), marks, marks + 1, [n]]))
            marked = set(marks.tolist())
            for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if new[start]:
                    held = []
                if start in marked:
                    held = carried[start].as_py()
                    continue
                for i, j, at in walk(instants[start:end].tolist(), held, limit, width):
                    admitted[start + i:start + j], free[start + i:start + j] = False, at
            last = client[n - 1].as_py()
            out = _decisions(client, part, us, seq, instants, np.zeros(n, bool), admitted, free)
            yield out.filter(carried.is_null())
    return run


def admit_requests(spark: SparkSession, log: DataFrame, limit: int = config.RATE_LIMIT,
                   window_s: int = config.RATE_WINDOW_S) -> DataFrame:
    """Decide every request of ``(client, ts, seq)`` as a sliding-window limiter would.

    Only admitted requests occupy the window, so decisions depend on earlier ones.  The log is sorted
    by client and time over ranges, and each partition is walked once, with the last ``limit``
    admissions at hand.  A client that goes on over a border is cut at the first request before which a
    whole window was calm; what lies before a cut is walked in a second pass from what the
    partition before held at its end.  Two passes decide any log, however long it is or how often it
    is busy.  Only a client that has no calm window over whole partitions is walked on by one task, as a
    stream that holds ``limit`` instants and skips refusals: its admissions are one chain.

    Requests without a client or a time are admitted and occupy no window.
    """
    columns = log.select(F.col("client").cast("string"), "ts", F.col("seq").cast("bigint"))
    free = columns.withColumn("admitted", F.lit(True)).withColumn("retry_after", F.lit(None).cast("double"))
    if limit <= 0 or window_s <= 0:
        return free
    width = window_s * 1_000_000
    usable = F.col("client").isNotNull() & F.col("ts").isNotNull()
    hits = columns.where(usable).select("client", F.unix_micros("ts").alias("us"), "seq")
    dealt = hits.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "client", "us", "seq").sortWithinPartitions("client", "us", "seq")
    path = scratch_path(spark, "limiter")
    dealt.mapInArrow(_decide_parts(limit, width), _DECIDED).write.parquet(path)
    decided = spark.read.schema(_DECIDED).parquet(path)
    rest = (decided.where("admitted is null").repartition("client")
            .sortWithinPartitions("client", "part", F.col("us").asc_nulls_first(), "seq").mapInArrow(_decide_open(limit, width), _DECIDED))
    both = decided.where("admitted is not null").unionByName(rest)
    return both.select("client", F.timestamp_micros("us").alias("ts"), "seq", "admitted", "retry_after").unionByName(free.where(~usable))


def daily_budget(requests: DataFrame, budget: int = config.DAILY_BUDGET) -> DataFrame:
    """Cold runs against the budget of their UTC day: the first ``budget`` of a day are allowed.

    The position of a day's last allowed run is found with a rank bound ahead of the shuffle and
    joined back; a busy day is not sorted as a whole.
    """
    day = F.date_trunc("day", "ts")
    dated = requests.withColumn("day", day)
    retry = (F.unix_micros(F.col("day") + F.expr("interval 1 day")) - F.unix_micros("ts")) / F.lit(1_000_000.0)
    if budget <= 0:
        return dated.withColumn("allowed", F.lit(True)).withColumn("retry_after", F.lit(None).cast("double"))
    first = Window.partitionBy("day").orderBy("ts", "seq")
    last = (dated.select("day", "ts", "seq").withColumn("_k", F.row_number().over(first))
            .filter(F.col("_k") <= budget).groupBy("day")
            .agg(F.max(F.struct("ts", "seq")).alias("cut")))
    # a request without a time belongs to no day: it is handed back as not allowed
    return (dated.join(last, "day", "left")
            .withColumn("allowed", F.coalesce(F.struct("ts", "seq") <= F.col("cut"), F.lit(False))).drop("cut")
            .withColumn("retry_after", F.when(~F.col("allowed"), retry)))


def budget_allows(used: Column | str, budget: Column | str) -> Column:
    used, budget = (F.col(c) if isinstance(c, str) else c for c in (used, budget))
    return (budget <= 0) | (used < budget)
