"""Toxicity: cumulative-link ordinal regression on sparse text features.

Features are words (A-Z folded, ASCII punctuation at the end cut) and their beginnings of
``PREFIXES`` bytes, hashed into ``2**BITS`` counters; the ``SELECTED`` counters whose document
frequency differs most between toxic and other texts are kept.  The labels only say toxic or
not; severity grades order the toxic texts by their share of telling words, cut at the terciles
of the learned rows.  One weight vector serves all thresholds:
``P(grade > k) = sigmoid(weights . x - threshold_k)``, and the expected severity is their sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOBS, blobs, labelled, saved, span_hasher, summed, text_slices, word_spans

BITS = 20
PREFIXES = (4, 5, 6)
SELECTED = 2048
GRADES = 4
#: Documents that are learned from at most; a documented bound of the fit, not of what is scored.
MOST_LABELLED = 50_000
STEPS = 400
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b".,;:!?\"')]}")] = True


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and counter of every word and word beginning; and the words of each row."""
    starts, ends = word_spans(data, bounds)
    n = len(bounds) - 1
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(n, np.int64)
    for _ in range(3):
        ends = ends - (_PUNCTUATION[data[ends - 1]] & (ends - starts > 1))
    row = np.searchsorted(bounds, starts, "right") - 1
    hashes = span_hasher(data, lower=True)
    shift = np.uint64(64 - BITS)
    rows, found = [row], [hashes(starts, ends) >> shift]
    for size in PREFIXES:
        longer = ends - starts > size
        s = starts[longer]
        rows.append(row[longer])
        found.append(hashes(s, s + size) >> shift)
    return np.concatenate(rows), np.concatenate(found).astype(np.int64), np.bincount(row, minlength=n)


def _once(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs and how often each occurs."""
    both, counts = np.unique((row << BITS) | value, return_counts=True)
    return both >> BITS, both & (2**BITS - 1), counts


@dataclass(frozen=True)
class Model:
    """Slot of each counter (-1: not used), weights of the slots, and the ordered thresholds."""
    slots: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def exceeds(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """P(grade > k) per row and threshold k."""
        row, counter, _ = features(data, bounds)
        slot = self.slots[counter]
        used = slot >= 0
        row, slot, n = _once(row[used], slot[used].astype(np.int64))
        linear = np.bincount(row, self.weights[slot] * np.log1p(n), minlength=len(bounds) - 1)
        return _sigmoid(linear[:, None] - self.thresholds)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(row: np.ndarray, slot: np.ndarray, value: np.ndarray, grade: np.ndarray, slots: int,
                steps: int = STEPS, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of least penalised log loss, by full-batch Adam; thresholds stay ordered.

    With ``s_k = P(grade > k)`` (and ``s_-1 = 1``, ``s_top = 0``) a row of grade y has the
    likelihood ``s_{y-1} - s_y``.
    """
    n, cuts = len(grade), GRADES - 1
    weights = np.zeros(slots)
    shape = np.concatenate([[2.0], np.zeros(cuts - 1)])  # first threshold and logs of the gaps
    first, second = np.zeros(slots + cuts), np.zeros(slots + cuts)
    at = np.arange(n)
    for step in range(1, steps + 1):
        gaps = np.exp(shape[1:])
        thresholds = shape[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        linear = np.bincount(row, weights[slot] * value, minlength=n)
        s = _sigmoid(linear[:, None] - thresholds)
        edge = np.column_stack([np.ones(n), s, np.zeros(n)])
        slope = np.column_stack([np.zeros(n), s * (1 - s), np.zeros(n)])
        likelihood = np.maximum(edge[at, grade] - edge[at, grade + 1], 1e-12)
        high, low = slope[at, grade] / likelihood, slope[at, grade + 1] / likelihood
        by_linear = (low - high) / n
        by_cut = np.zeros((n, GRADES + 1))
        by_cut[at, grade] += high / n
        by_cut[at, grade + 1] -= low / n
        cut = by_cut[:, 1:GRADES].sum(axis=0)
        tail = np.cumsum(cut[::-1])[::-1]
        gradient = np.concatenate([np.bincount(slot, by_linear[row] * value, minlength=slots) + decay * weights,
                                   [tail[0]], tail[1:] * gaps])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights -= move[:slots]
        shape -= move[slots:]
    return weights, shape[0] + np.concatenate([[0.0], np.cumsum(np.exp(shape[1:]))])


def _document_frequencies(rows: DataFrame) -> np.ndarray:
    """Documents with each counter's feature: a row for other texts and one for toxic ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2**BITS), np.int64)
        for batch in batches:
            toxic = (batch.column(1).to_numpy() > 0).astype(np.int64)
            for i, _, data, bounds in text_slices(batch.column(0)):
                row, counter, _ = features(data, bounds)
                row, counter, _ = _once(row, counter)
                for kind in (0, 1):
                    total[kind] += np.bincount(counter[toxic[i + row] == kind], minlength=2**BITS)
        yield blobs(total.ravel(), 1 << 14)
    return summed(rows.select("text", "label").mapInArrow(run, BLOBS), 2 << BITS, 1 << 14, "int64").reshape(2, -1)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn ``labels.toxic`` from at most ``MOST_LABELLED`` rows; held-out rows are never read.

    Without labels of both kinds nothing is toxic.
    """
    # saved first: a coalesce of the join would scan all documents in so few tasks
    rows = saved(saved(labelled(docs, labels, "toxic", MOST_LABELLED), "toxic-labelled").coalesce(8), "toxic-rows")
    total = {r["label"]: r["count"] for r in rows.withColumn("label", (F.col("label") > 0).cast("int")).groupBy("label").count().collect()}
    nothing = Model(np.full(2**BITS, -1, np.int32), np.zeros(1), np.array([30.0, 31.0, 32.0]))
    if not total.get(0) or not total.get(1):
        return nothing
    df = _document_frequencies(rows)
    rate = (df[1] + 0.5) / (total[1] + 1), (df[0] + 0.5) / (total[0] + 1)
    odds = np.log(rate[0] / rate[1])
    worth = np.where(df.sum(axis=0) >= 3, np.abs(odds) * np.sqrt(df.sum(axis=0)), 0)
    chosen = np.sort(np.argsort(-worth, kind="stable")[:SELECTED])
    chosen = chosen[worth[chosen] > 0]
    if not len(chosen):
        return nothing
    slots = np.full(2**BITS, -1, np.int32)
    slots[chosen] = np.arange(len(chosen))
    telling = np.zeros(2**BITS, bool)
    telling[chosen[(odds[chosen] > 2) & (df[1][chosen] >= 3)]] = True

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in text_slices(batch.column(0)):
                row, counter, words = features(data, bounds)
                share = np.bincount(row[telling[counter]], minlength=j - i) / np.maximum(words, 1)
                used = slots[counter] >= 0
                row, slot, n = _once(row[used], slots[counter[used]].astype(np.int64))
                at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=j - i))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(i, j - i), pa.array(share),
                     pa.ListArray.from_arrays(pa.array(at), pa.array(slot.astype(np.int32))),
                     pa.ListArray.from_arrays(pa.array(at), pa.array(np.log1p(n).astype(np.float32)))],
                    ["label", "share", "slots", "amounts"])
    table = rows.select("text", "label").mapInArrow(sparse, "label double, share double, slots array<int>, amounts array<float>").toArrow()
    toxic, share = table["label"].to_numpy() > 0, table["share"].to_numpy()
    cuts = np.quantile(share[toxic], np.arange(1, GRADES - 1) / (GRADES - 1))
    grade = np.where(toxic, 1 + np.searchsorted(cuts, share, "left"), 0)
    listed = table["slots"].combine_chunks()
    row = np.repeat(np.arange(len(grade)), np.diff(listed.offsets.to_numpy()))
    amounts = table["amounts"].combine_chunks().flatten().to_numpy().astype(np.float64)
    weights, thresholds = fit_ordinal(row, listed.flatten().to_numpy().astype(np.int64), amounts, grade, len(chosen))
    return Model(slots, weights, thresholds)


def severity(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, expected_severity, grade, p_toxic, toxic)`` of every whole text, one row per row.

    ``expected_severity`` lies between 0 and 3, ``grade`` is the likeliest grade, ``toxic`` says
    that a grade above 0 is likelier than not.  Null and empty texts are scored as wordless.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in text_slices(batch.column(1)):
                above = model.exceeds(data, bounds)
                each = -np.diff(np.column_stack([np.ones(j - i), above, np.zeros(j - i)]), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.round(above.sum(axis=1), 9)),
                     pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(np.round(above[:, 0], 9))],
                    ["doc_id", "expected_severity", "grade", "p_toxic"])
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, expected_severity double, grade int, p_toxic double")
    return scored.withColumn("toxic", (F.col("p_toxic") > 0.5).cast("int"))
