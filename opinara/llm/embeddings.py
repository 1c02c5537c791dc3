"""Near-duplicate vectors: random-hyperplane tables, exact cosines, connected components.

Equal vectors of a label form a class first.  ``T`` tables of ``K`` sign bits propose pairs of
classes; both numbers follow from the number of classes, so that a pair of cosine 0.98 is
missed by all tables with probability below ``MISS``.  Buckets are met in block pairs of bounded
size, as matrix products; a pair counts in the first table that it shares, and only degrees and
a spanning set of links leave a task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, saved
from .graph import connected_components

MISS = 1e-8
BLOCK = 512
#: Rows that a task meets at once, about: whole block pairs are dealt to cells of this size.
CELL = 20_000
SEED = 23


def tables_for(n: int, threshold: float) -> tuple[int, int]:
    """Bits per table and number of tables for ``n`` vectors."""
    bits = max(8, min(24, round(math.log2(max(n, 1) / 128))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-agree))


def _keys(vectors: np.ndarray, labels: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Bucket of each vector (all of one length) in each table; vectors of other labels get other buckets."""
    d = vectors.shape[1]
    planes = np.random.default_rng([SEED, d]).normal(size=(d, tables * bits))
    out = np.empty((len(vectors), tables), np.uint64)
    for at in range(0, len(vectors), 4096):
        part = vectors[at:at + 4096]
        part = part / np.abs(part).max(axis=1, keepdims=True)
        signs = (part @ planes >= 0).reshape(len(part), tables, bits)
        out[at:at + 4096] = (signs << np.arange(bits)).sum(axis=2)
    salt = mix(labels.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(d))
    return mix(mix(out + salt[:, None]) + np.arange(tables, dtype=np.uint64)).view(np.int64)


def _hashed(bits: int, tables: int, kind: str):
    """Class key, bucket of each table and bytes of each vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(2).to_numpy()
            values = [np.asarray(v, kind) + 0 for v in batch.column(1).to_pylist()]
            size = np.array([len(v) for v in values])
            for d in np.unique(size):
                mine = np.flatnonzero(size == d)
                vectors = np.stack([values[k] for k in mine])
                names = [hashlib.blake2b(v.tobytes() + str(label).encode(), digest_size=16).digest()
                         for v, label in zip(vectors, labels[mine])]
                keys = _keys(vectors.astype(np.float64), labels[mine], bits, tables)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(mine)), pa.array(labels[mine]), pa.array(names, pa.binary()),
                     pa.array(list(keys), pa.list_(pa.int64())), pa.array([v.tobytes() for v in vectors], pa.binary())],
                    ["id", "label", "class", "keys", "vector"])
    return run


def _met(threshold: float, bits: int, tables: int, kind: str):
    """Degrees and spanning links of the block pairs in one cell, all buckets at once."""
    def one_length(rows: pd.DataFrame) -> list[tuple]:
        rows = rows.sort_values(["bucket", "i", "j", "id"], ignore_index=True)
        ids, weight, bucket = (rows[c].to_numpy() for c in ("id", "m", "bucket"))
        unique, first, place = np.unique(ids, return_index=True, return_inverse=True)
        vectors = np.frombuffer(b"".join(rows["vector"].iloc[first]), kind).reshape(len(unique), -1).astype(np.float64)
        keys = _keys(vectors, rows["label"].to_numpy()[first], bits, tables)
        # by a power of two, which leaves every cosine as it is and keeps squares in range
        vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])
        norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        table = (keys[place] == bucket[:, None]).argmax(axis=1)
        i, j, block = (rows[c].to_numpy() for c in ("i", "j", "block"))
        new = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        head = np.flatnonzero(new)
        end = np.repeat(np.append(head[1:], len(rows)), np.diff(np.append(head, len(rows))))
        degree = np.zeros(len(unique), np.int64)
        root = np.arange(len(unique))

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c
        links, active, shift = [], np.arange(len(rows)), 0
        while len(active):
            shift += 1
            active = active[active + shift < end[active]]
            for at in range(0, len(active), 1 << 16):
                a = active[at:at + (1 << 16)]
                b = a + shift
                a = a[(i[a] == j[a]) | (block[a] != block[b])]
                b = a + shift
                x, y = place[a], place[b]
                near = np.einsum("ij,ij->i", vectors[x], vectors[y]) / (norms[x] * norms[y]) >= threshold
                x, y, t = x[near], y[near], table[a[near]]
                same = keys[x] == keys[y]
                counts = same.argmax(axis=1) == t  # a pair counts in the first table it shares
                x, y = x[counts], y[counts]
                np.add.at(degree, x, weight[first[y]])
                np.add.at(degree, y, weight[first[x]])
                for u, v in zip(x.tolist(), y.tolist()):
                    p, q = find(u), find(v)
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        links.append((unique[u], unique[v], 0))
        return [*links, *((a, a, d) for a, d in zip(unique, degree) if d)]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in rows.groupby(rows["vector"].str.len()):
            out += one_length(part)
        return pd.DataFrame(out, columns=["a", "b", "degree"], dtype="int64")
    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row of ``vectors(vec_id, embedding, label)``.

    Vectors of one label and one length link if their cosine in double precision reaches
    ``threshold``; ``n_links`` counts the other rows linked directly, copies included, and
    ``component_id`` is the smallest vec_id reachable.  Rows without label, or whose vector is
    null, empty, zero or holds null or non-finite numbers, link with nothing.  A row without
    vec_id gets a null component.  Other columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), "embedding", "label")
    # a null inside makes exists() null, so only a sound vector gives true
    sound = (F.col("label").isNotNull() & F.col("id").isNotNull() & (F.size("embedding") > 0)
             & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
             & F.exists("embedding", lambda v: v != 0))
    usable = rows.where(F.coalesce(sound, F.lit(False)))
    bits, tables = tables_for(usable.count(), threshold)
    kind = "<f4" if "float" in dict(vectors.dtypes)["embedding"] else "<f8"
    numbers = "array<float>" if kind == "<f4" else "array<double>"
    hashed = saved(usable.select("id", F.col("embedding").cast(numbers), F.col("label").cast("long")).mapInArrow(
        _hashed(bits, tables, kind), "id long, label long, class binary, keys array<long>, vector binary"), "hashed-vectors")
    classes = saved(hashed.groupBy("class").agg(F.min("id").alias("rep"), F.count("*").alias("m")), "vector-classes")
    reps = saved(hashed.join(classes, "class").where("id = rep").dropDuplicates(["class"])
                 .select("id", "m", "label", "keys", "vector"), "vector-reps")
    spread = reps.select("id", F.explode("keys").alias("bucket"))
    sizes = spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    dealt = (spread.join(sizes, "bucket").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
             .withColumn("block", F.pmod(F.hash("id"), F.col("blocks")))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
             .select("bucket", "id", "block", "i", "j"))
    dealt = saved(dealt, "vector-buckets")
    cells = max(1, -(-dealt.count() // CELL))
    met = saved(dealt.join(reps.drop("keys"), "id").withColumn("cell", F.pmod(F.hash("bucket", "i", "j"), F.lit(cells)))
                .groupBy("cell").applyInPandas(_met(threshold, bits, tables, kind), "a long, b long, degree long"), "vector-links")
    degrees = met.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("degree").alias("degree"))
    labels = connected_components(met.where("a <> b").select("a", "b")).toDF("rep", "component")
    known = (hashed.select("id", "class").join(classes, "class").join(degrees, "rep", "left").join(labels, "rep", "left")
             .select("id", (F.coalesce("degree", F.lit(0)) + F.col("m") - 1).alias("links"),
                     F.coalesce("component", "rep").alias("component")))
    alone = (rows.where(~F.coalesce(sound, F.lit(False)))
             .select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component")))
    every = known.union(alone)
    return every.select(F.col("id").alias("vec_id"), F.col("links").cast("long").alias("n_links"),
                        F.col("component").alias("component_id"),
                        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
