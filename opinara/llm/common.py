"""What several training-data operators share: scratch tables, checked semi-joins, word hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.session import scratch_path

#: Key sets up to this many rows are broadcast (16 MB of longs); larger ones are joined by a shuffle.
BROADCAST_KEYS = 1_000_000

#: Bytes of text that a task hashes at once; a longer text is one slice by itself.
SLICE_BYTES = 1 << 20


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys`` (a saved table); broadcast only if a count proves it small."""
    n = keys.limit(BROADCAST_KEYS + 1).count()
    return df.join(F.broadcast(keys) if n <= BROADCAST_KEYS else keys, on, "left_semi")


def with_text(changed: DataFrame, column: str, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with ``text`` from ``column`` of ``changed`` and ``n_chars``, if there is one, to match."""
    return changed.select(*(F.col(column).alias(c) if c == "text" else F.length(column).cast(docs.schema[c].dataType).alias(c)
                            if c == "n_chars" else F.col(c) for c in docs.columns))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- hashing of words ---------------------------------------------------------------------

_rng = np.random.default_rng(20240917)
_BYTES = _rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        made = []
        for base in (_BASE, _INVERSE):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p))
        if n > 2 * SLICE_BYTES:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``i`` to ``j`` of a string column with their UTF-8 bytes and row bounds; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    bounds = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and bounds[-1] else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + SLICE_BYTES, "right")) - 1)
        yield i, j, data[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i]
        i = j


def span_hasher(data: np.ndarray, lower: bool = False):
    """A function of starts and ends: 64-bit hashes of those spans of ``data``; ``lower`` folds A-Z.

    The hash is a polynomial over a random value per byte, so one running sum serves all spans.
    """
    n = len(data)
    power, inverse = _power(max(n, 1))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER if lower else _BYTES)[data] * power[:n], out=total[1:])

    def hashes(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        value = (total[ends] - total[starts]) * inverse[starts]
        return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of ``data``: runs without ASCII white space inside a row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~SPACE[data]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    starts = np.flatnonzero(word & (~before | first[:n]))
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    return starts, ends


def hash_words(data: np.ndarray, bounds: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of ``data``."""
    starts, ends = word_spans(data, bounds)
    return span_hasher(data, lower)(starts, ends), starts, ends


# --- sums of arrays of a fixed size ---------------------------------------------------------

def blobs(values: np.ndarray, chunk: int) -> pa.RecordBatch:
    """``(chunk, values)`` rows of a flat array, each with ``chunk`` 8-byte values."""
    parts = [values[i:i + chunk].tobytes() for i in range(0, len(values), chunk)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())],
                                      ["chunk", "values"])


BLOBS = "chunk int, values binary"


def summed(parts: DataFrame, size: int, chunk: int, dtype: str) -> np.ndarray:
    """The sum of the arrays that tasks sent as ``blobs``; added up in tasks by chunk, so the driver gets one array."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[at] = total.get(at, 0) + np.frombuffer(values, dtype)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()),
                                          pa.array([v.tobytes() for v in total.values()], pa.binary())], ["chunk", "values"])
    out = np.zeros(size, dtype)
    for at, values in parts.repartition(16, "chunk").mapInArrow(add, BLOBS).collect():
        out[at * chunk:(at + 1) * chunk] = np.frombuffer(values, dtype)
    return out


# --- labelled rows ----------------------------------------------------------------------------

def held_out(doc_id):
    """Rows that no model learns from: crc32 of the decimal id leaves 2 when divided by 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def hash_bound(total: int, most: int) -> int:
    """A 64-bit hash that about a tenth more than ``most`` of ``total`` rows stay below; ten standard errors keep it from too few."""
    share = (1.1 * most + 10 * most ** 0.5 + 100) / max(total, 1)
    return min(2**63 - 1, int(share * 2**64) - 2**63)


def labelled(docs: DataFrame, labels: DataFrame, column: str, most: int) -> DataFrame:
    """``(doc_id, text, label)`` of up to ``most`` labelled documents, held-out ones left out.

    Which ones is decided by a hash of the id, the lowest count; of repeated labels the largest counts.  A bound on
    the hash leaves little more than ``most`` rows to be sorted, however many are labelled.
    """
    rows = (labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
            .groupBy("doc_id").agg(F.max(column).cast("double").alias("label")))
    chosen = (rows.where(F.xxhash64("doc_id") <= hash_bound(rows.count(), most))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    chosen = saved(chosen, "labelled")
    small = chosen.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return docs.select("doc_id", "text").join(F.broadcast(chosen) if small else chosen, "doc_id")
