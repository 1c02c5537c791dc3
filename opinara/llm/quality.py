"""Quality classifier: random Fourier features, partition-summed ridge regression, isotonic calibration.

A document is described by statistics of its whole text; their Gaussian kernel is approximated
by ``FEATURES`` random cosines.  Tasks sum the normal equations of their labelled rows, so only
one matrix reaches the driver; raw scores are then calibrated on rows that the regression did
not see, by pooling adjacent violators over counted score bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import BLOBS, blobs, labelled, saved, span_hasher, summed, text_slices, word_spans

FEATURES = 256
RIDGE = 1e-2
#: Documents that are learned from at most; a documented bound of the fit, not of what is scored.
MOST_LABELLED = 200_000
ACCEPTED = 0.7
BINS = 2000
_CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".,;:?", "!", "#$%&*@^~=+<>", "|",
            "\n", "\"'()[]{}-/_\\`")
_MEMBER = np.zeros((len(_CLASSES), 256), bool)
for _i, _c in enumerate(_CLASSES):
    _MEMBER[_i, list(_c.encode())] = True
STATISTICS = len(_CLASSES) + 8


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[bounds])


def statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` numbers per text."""
    size = np.diff(bounds)
    many = np.maximum(size, 1)
    counts = np.stack([_per_row(m[data], bounds) for m in _MEMBER])
    starts, ends = word_spans(data, bounds)
    row = np.searchsorted(bounds, starts, "right") - 1
    n = len(size)
    words = np.bincount(row, minlength=n)
    some = np.maximum(words, 1)
    distinct = np.zeros(n, np.int64)
    if len(row):
        hashes = span_hasher(data)(starts, ends)
        step = 1 << 20
        for low in range(0, n, step):
            a, b = np.searchsorted(row, (low, low + step))
            both = np.sort(((row[a:b] - low).astype(np.uint64) << np.uint64(44)) | (hashes[a:b] >> np.uint64(20)))
            fresh = np.concatenate([[True], both[1:] != both[:-1]])
            distinct += np.bincount((both[fresh] >> np.uint64(44)).astype(np.int64) + low, minlength=n)
    upper, symbol = _MEMBER[0][data], _MEMBER[4][data] | _MEMBER[5][data] | _MEMBER[6][data]
    shout = upper[starts] & upper[ends - 1 - (ends - starts > 1)] if len(row) else np.zeros(0, bool)
    marked = symbol[ends - 1] if len(row) else np.zeros(0, bool)
    length = (ends - starts).astype(np.float64)
    mean = np.bincount(row, length, minlength=n) / some
    spread = np.sqrt(np.maximum(np.bincount(row, length**2, minlength=n) / some - mean**2, 0))
    lines = counts[7] + 1
    return np.column_stack([*np.sqrt(counts / many), np.log1p(size), np.log1p(words), mean, spread, distinct / some,
                            np.sqrt(np.bincount(row[shout], minlength=n) / some),
                            np.sqrt(np.bincount(row[marked], minlength=n) / some), np.log1p(words / lines)])


@dataclass(frozen=True)
class Model:
    """What a fit found: scaling of the statistics, weights of the cosines, and the calibration's knots."""
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray
    seed: int = 11

    def cosines(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        directions = rng.normal(0, 1 / np.sqrt(stats.shape[1]), (stats.shape[1], FEATURES))
        phase = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((stats - self.centre) / self.scale, -8, 8)
        return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(z @ directions + phase), np.ones(len(stats))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.cosines(stats) @ self.weights

    def scores(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated scores; a thousandth of the raw score keeps the order inside a flat stretch."""
        if not len(self.weights):
            return np.full(len(stats), self.values[0])
        raw = self.raw(stats)
        return np.round(0.999 * np.interp(raw, self.knots, self.values) + 0.001 * np.clip(raw, 0, 1), 9)


def pool_adjacent(x: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and values of the increasing step function nearest to the rates ``good / n`` at ``x``."""
    blocks: list[list[float]] = []
    for at, g, m in zip(x, good, n):
        blocks.append([at * m, g, m])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    rows = np.array(blocks)
    return rows[:, 0] / rows[:, 2], rows[:, 1] / rows[:, 2]


def _with_statistics(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in text_slices(batch.column(1)):
                stats = statistics(data, bounds)
                offsets = np.arange(0, stats.size + 1, stats.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(stats.ravel()))], ["doc_id", "label", "stats"])
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label").mapInArrow(
        run, "doc_id long, label double, stats array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn ``labels.quality`` from at most ``MOST_LABELLED`` rows; held-out rows are never read.

    Without labels of both kinds every text scores the share of good ones (1 without any label).
    """
    rows = saved(_with_statistics(labelled(docs, labels, "quality", MOST_LABELLED)), "quality-rows")
    rows = rows.withColumn("calibrates", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 3)
    seen = rows.where("not calibrates")
    moments = rows.agg(F.count("*"), F.avg("label"), *(f(F.col("stats")[i]) for i in range(STATISTICS)
                                                      for f in (F.avg, F.stddev_pop))).first()
    share = moments[1]
    if not moments[0] or share in (0.0, 1.0) or seen.isEmpty():
        return Model(*[np.zeros(0)] * 4, np.array([1.0 if share is None else share]))
    centre, scale = np.round(np.array(moments[2::2]), 12), np.round(np.array(moments[3::2]), 12)
    model = Model(centre, np.where(scale > 0, scale, 1.0), np.zeros(0), np.zeros(0), np.zeros(0))
    width = FEATURES + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width + 1))
        for batch in batches:
            z = model.cosines(_matrix(batch.column(1)))
            total += z.T @ np.column_stack([z, batch.column(0).to_numpy()])
        yield blobs(total.ravel(), 16 * (width + 1))
    total = summed(seen.select("label", "stats").mapInArrow(equations, BLOBS), width * (width + 1), 16 * (width + 1), "float64")
    total = total.reshape(width, width + 1)
    gram = total[:, :width] + RIDGE * np.diag([1.0] * FEATURES + [0.0])
    model = Model(centre, model.scale, np.linalg.solve(gram + 1e-9 * np.eye(width), total[:, width]), np.zeros(0), np.zeros(0))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.clip(model.raw(_matrix(batch.column(1))), -0.5, 1.5)
            yield pa.RecordBatch.from_arrays([pa.array(np.round(raw * BINS).astype(np.int32)), batch.column(0)], ["bin", "label"])
    unseen = rows.where("calibrates")
    counted = ((unseen if not unseen.isEmpty() else seen).select("label", "stats").mapInArrow(bins, "bin int, label double")
               .groupBy("bin").agg(F.sum("label"), F.count("*")).orderBy("bin").collect())
    x, good, n = (np.array(c, float) for c in zip(*counted))
    knots, values = pool_adjacent(x / BINS, good, n)
    return Model(centre, model.scale, model.weights, knots, values)


def score(docs: DataFrame, model: Model, score_as: str = "quality_score", accepted_as: str = "accepted") -> DataFrame:
    """All columns of ``docs`` and ``quality_score`` (0 to 1); ``accepted`` marks scores of 0.7 or more.

    Null texts count as empty; rows are never joined, so repeated ids and null ids are scored
    one by one.  Columns of those two names in ``docs`` are replaced.
    """
    docs = docs.drop(score_as, accepted_as)
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.scores(statistics(data, bounds)) for _, _, data, bounds in text_slices(batch.column(at))]
            scores = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, score_as])
    scored = docs.mapInArrow(run, StructType([*schema.fields, StructField(score_as, DoubleType())]))
    return scored.withColumn(accepted_as, F.col(score_as) >= ACCEPTED)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the classifier rejects; columns as they came."""
    return score(docs, fit(docs, labels), "__score", "__accepted").where("__accepted").select(*docs.columns)
