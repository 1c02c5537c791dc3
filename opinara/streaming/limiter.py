"""The sliding-window limiter as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from opinara import config
from opinara.operators.limits import walk

OUTPUT = "client string, ts timestamp, seq bigint, admitted boolean, retry_after double"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SlidingWindow(StatefulProcessor):
    """Keeps the admitted instants of a client that are still in the window, at most ``limit``.

    The requests of a client in a micro-batch are put together and decided one by one in time
    order, so the source's rate options bound what a task holds; the state never grows with
    traffic, and a timer drops idle clients.
    """

    def __init__(self, limit: int, window_s: int):
        self.limit, self.width = limit, window_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.admitted = handle.getListState("admitted", StructType([StructField("us", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        window = sorted(us for (us,) in self.admitted.get())
        batch = pd.concat([r[["ts", "seq"]] for r in rows], ignore_index=True).sort_values(["ts", "seq"], kind="stable")
        instants = batch["ts"].astype("datetime64[us]").astype("int64").to_numpy()
        admitted, retry = np.ones(len(batch), bool), np.full(len(batch), np.nan)
        if self.limit > 0 and self.width > 0:
            for i, j, free in walk(instants.tolist(), window, self.limit, self.width):
                admitted[i:j], retry[i:j] = False, np.maximum(1.0, (free - instants[i:j]) / 1e6)
            window = [us for us in window if us > instants[-1] - self.width]
        if window:
            self.admitted.put([(int(us),) for us in window])
        else:
            self.admitted.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if window:
            self.handle.registerTimer((window[-1] + self.width) // 1000 + 1)
        yield pd.DataFrame({"client": key[0], "ts": batch["ts"].tolist(), "seq": batch["seq"].tolist(),
                            "admitted": admitted, "retry_after": retry})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.admitted.clear()
        return iter([])

    def close(self) -> None:
        pass


def admit_stream(log: DataFrame, limit: int = config.RATE_LIMIT, window_s: int = config.RATE_WINDOW_S,
                 delay: str = "1 minute") -> DataFrame:
    """Decisions for a request stream ``(client, ts, seq)``; needs the RocksDB state store.

    Size micro-batches with the source's rate options: a client's requests of one micro-batch
    are decided together.  Requests later than the watermark are dropped by the engine's rules.
    """
    return (log.withWatermark("ts", delay).groupBy("client")
            .transformWithStateInPandas(statefulProcessor=SlidingWindow(limit, window_s), outputStructType=OUTPUT,
                                        outputMode="Append", timeMode="EventTime"))
