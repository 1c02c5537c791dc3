"""Places of rows in an order, and joins to one row per key, neither of which meets a hot key in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import saved, shuffle_partitions

#: A key is hot if it holds more than one row in so many; there are fewer hot keys than that.
HOT_ONE_IN = 1000


def numbered(df: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """``df``, saved, with ``pos``: the place of a row, from 0, among those of its ``key`` in ``order``.

    ``key`` is a string without nulls.  Rows are dealt by ranges of key and order, so a hot key is
    spread; ``order`` should end with a column that tells equal rows apart.  Only the first key of a
    partition can have rows in earlier ones, so one row per partition says how many.
    """
    schema = StructType([*df.schema.fields]).add("at", LongType()).add("part", LongType())
    at_key = df.columns.index(key)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            keys = batch.column(at_key)
            new = np.ones(n, bool)
            new[0] = keys[0].as_py() != last
            new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            at = np.arange(n)
            at -= np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [n]])))
            at[:starts[0] if len(starts) else n] += seen
            last, seen = keys[n - 1].as_py(), int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(np.full(n, part))],
                                             [*batch.schema.names, "at", "part"])
    dealt = (df.repartitionByRange(shuffle_partitions(df.sparkSession), F.col(key), *order)
             .sortWithinPartitions(F.col(key), *order).mapInArrow(places, schema))
    kept = saved(dealt, name)
    parts = (kept.groupBy("part").agg(F.min(key).alias("first"), F.max(F.struct(F.col(key).alias("key"), "at")).alias("last"))
             .orderBy("part").collect())
    before, rows, ended = [], 0, None
    for p in parts:
        rows = rows if p["first"] == ended else 0
        before.append((p["part"], p["first"], rows))
        rows = p["last"]["at"] + 1 + (rows if p["last"]["key"] == p["first"] else 0)
        ended = p["last"]["key"]
    offsets = df.sparkSession.createDataFrame(before, "part long, first string, before long")
    return (kept.join(F.broadcast(offsets), "part")
            .select(*df.columns, (F.col("at") + F.when(F.col(key) == F.col("first"), F.col("before")).otherwise(0)).alias("pos")))


def join_values(rows: DataFrame, values: DataFrame, on: list[str], name: str, counts: DataFrame | None = None) -> DataFrame:
    """Inner join of ``rows`` to ``values``, which has one row per key; both are saved tables, keys have no nulls.

    Keys with more than a thousandth of all rows, so fewer than a thousand, are joined by a broadcast of
    their values; the others meet by a shuffle.  ``counts`` (keys, ``n``) saves counting the rows.
    """
    counts = counts if counts is not None else rows.groupBy(*on).agg(F.count("*").alias("n"))
    total = rows.count()
    hot = saved(counts.where(F.col("n") * HOT_ONE_IN > total).select(*on).join(values, on), f"{name}-hot")
    keys = F.broadcast(hot.select(*on))
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(keys, on, "left_anti").join(values, on))
