"""Near-duplicate documents by b-bit MinHash, confirmed on whole shingle sets.

Documents with equal word sequences form a class first, so thousands of copies cost one row.
Class representatives are banded (``BANDS`` x ``ROWS`` minima, missing a pair of similarity
0.8 with probability 3e-6); of every minimum only ``BITS`` low bits are kept, packed into
longs.  Within a bucket each member meets the bucket's smallest id; a pair whose
collision-corrected estimate lies five standard errors below the threshold is dropped unless
one set has fewer than ``SMALL`` shingles, the others are confirmed on their full sets.  Members that such a star leaves outside
a bucket's main component meet members of the main and of the next one, in rounds that go on while they pay.
Those still in different components then meet in blocks of bounded size, so that no link between
different texts is lost and no pair list grows with the square of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, keep_keys, mix, saved, text_slices
from .graph import connected_components

BANDS, ROWS, BITS = 32, 5, 2
HASHES = BANDS * ROWS
#: Pairs with a set below this size are confirmed whatever the estimate says.
SMALL = 64
#: Members of a bucket that one side of a block pair holds.
BLOCK = 256
#: A further round of stars follows while the last one has linked at least one in so many of those left.
PAYS = 10
#: Members of a component that a document meets in a round.
MEETS = 16
_rng = np.random.default_rng(7)
_A = _rng.integers(0, 2**31, HASHES).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)

Documents = Iterator[pa.RecordBatch]


def _shingles(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Per document the sorted distinct hashes of its shingles; and two hashes of its word sequence."""
    words, starts, _ = hash_words(data, bounds, lower=True)
    first = np.searchsorted(starts, bounds)
    n = len(words)
    rolled = words.copy()
    for k in range(1, width):
        if n > k:
            rolled[:n - k] = mix(rolled[:n - k] * np.uint64(0x9E3779B97F4A7C15) + words[k:])
    sets = []
    for i, j in zip(first[:-1], first[1:]):
        if j - i >= width:
            s = np.sort(rolled[i:j - width + 1])
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif j > i:
            s = words[i:i + 1]
            for k in range(i + 1, j):
                s = mix(s * np.uint64(0x9E3779B97F4A7C15) + words[k:k + 1])
        else:
            s = words[:0]
        sets.append(s)
    place = np.arange(n, dtype=np.uint64) - np.repeat(first[:-1], np.diff(first)).astype(np.uint64)
    keys = []
    for terms in (mix(words + place * np.uint64(0xA24BAED4963EE407)),
                  mix(words ^ (place * np.uint64(0x9FB21C651E98DF25) + np.uint64(1)))):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        keys.append(total[first[1:]] - total[first[:-1]])
    return sets, keys[0], keys[1]


def _signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and packed low bits of the minima of non-empty sets."""
    sizes = np.array([len(s) for s in sets])
    x = (np.concatenate(sets) >> np.uint64(17)).astype(np.uint32)
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    minima = np.empty((HASHES, len(sets)), np.uint32)
    for k in range(HASHES):
        minima[k] = np.minimum.reduceat(x * _A[k] + _B[k], at)
    keys = np.empty((len(sets), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(sets), b + 1, np.uint64)
        for r in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + minima[b * ROWS + r])
        keys[:, b] = key
    # mixed per function: the low bits of x * A + B agree in all functions at once
    salt = np.arange(1, HASHES + 1, dtype=np.uint64)[:, None] << np.uint64(32)
    low = mix(minima + salt) & np.uint64(2**BITS - 1)
    per = 64 // BITS
    packed = np.zeros((len(sets), math.ceil(HASHES / per)), np.uint64)
    for k in range(HASHES):
        packed[:, k // per] |= low[k] << np.uint64(BITS * (k % per))
    return keys.view(np.int64), packed.view(np.int64)


def _lists(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)),
                                    pa.array(np.ascontiguousarray(rows).ravel()))


def signatures(docs: DataFrame, width: int = 2) -> DataFrame:
    """``(id, n, k1, k2, bands, bits)`` per row: set size, sequence hashes, band keys, packed minima.

    A null or wordless text has ``n`` 0 and no bands.
    """
    def run(batches: Documents) -> Documents:
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, bounds in text_slices(batch.column(1)):
                sets, k1, k2 = _shingles(data, bounds, width)
                full = [s for s in sets if len(s)]
                sizes = np.array([len(s) for s in sets], np.int64)
                keys, bits = (np.zeros((len(sets), BANDS), np.int64),
                              np.zeros((len(sets), math.ceil(HASHES * BITS / 64)), np.int64))
                if full:
                    keys[sizes > 0], bits[sizes > 0] = _signatures(full)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(sizes), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)),
                     _lists(keys), _lists(bits)], ["id", "n", "k1", "k2", "bands", "bits"])
    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(
        run, "id long, n long, k1 long, k2 long, bands array<long>, bits array<long>")


def shingle_sets(docs: DataFrame, width: int = 2) -> DataFrame:
    """``(id, k1, k2, items)``: the full shingle set of each row."""
    def run(batches: Documents) -> Documents:
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, bounds in text_slices(batch.column(1)):
                sets, k1, k2 = _shingles(data, bounds, width)
                at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                items = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), items],
                    ["id", "k1", "k2", "items"])
    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(
        run, "id long, k1 long, k2 long, items array<long>")


def _lowest_agreement(threshold: float) -> float:
    """Share of equal low bits below which a pair of ``threshold`` practically never falls."""
    chance = 2.0 ** -BITS
    p = chance + threshold * (1 - chance)
    return p - 5 * math.sqrt(p * (1 - p) / HASHES)


def agreement(a: str, b: str):
    """Share of equal low bits of two packed columns, by bit counts."""
    fold = "x.z" if BITS == 1 else "(x.z | shiftrightunsigned(x.z, 1)) & 6148914691236517205L"
    differing = F.expr(f"aggregate(transform(zip_with({a}, {b}, (u, v) -> named_struct('z', u ^ v)), "
                       f"x -> bit_count({fold})), 0, (s, c) -> s + c)")
    return 1 - differing / F.lit(float(HASHES))


def estimated_similarity(a: str, b: str):
    """Jaccard similarity corrected for low bits that agree by chance."""
    chance = 2.0 ** -BITS
    return (agreement(a, b) - F.lit(chance)) / F.lit(1 - chance)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold: 100 * intersection >= percent * union."""
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("x", "y")))
    return both.where(100 * F.col("common") >= percent * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b")


def _across(percent: int):
    """Confirmed links from probes to targets of other components in one block pair; a spanning set of them."""
    lowest, few = _lowest_agreement(percent / 100), SMALL

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "probe"], ignore_index=True)
        ids, components = rows["id"].to_numpy(), rows["component"].to_numpy()
        bands = np.stack(rows["bands"].to_numpy())
        bits = np.stack(rows["bits"].to_numpy()).view(np.uint64)
        items = [np.asarray(x).view(np.uint64) for x in rows["items"]]
        small = np.array([len(x) < few for x in items])
        probe, minor = rows["probe"].to_numpy(), rows["minor"].to_numpy()
        targets = np.flatnonzero(~probe)
        here = int(np.flatnonzero((bands == rows["bucket"].iloc[0]).all(axis=0))[0])
        root = {c: c for c in np.unique(components).tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c
        out = []
        for x in np.flatnonzero(probe):
            others = targets[(components[targets] != components[x]) & (~minor[targets] | (ids[targets] > ids[x]))]
            if here and len(others):  # a pair is met in the first band it shares
                others = others[~(bands[others, :here] == bands[x, :here]).any(axis=1)]
            if not len(others):
                continue
            z = bits[others] ^ bits[x]
            if BITS == 2:
                z = (z | (z >> np.uint64(1))) & np.uint64(0x5555555555555555)
            same = 1 - np.bitwise_count(z).sum(axis=1) / HASHES
            for y in others[(same >= lowest) | small[others] | small[x]]:
                p, q = find(int(components[x])), find(int(components[y]))
                if p == q:
                    continue
                s, t = items[x], items[y]
                if len(s) > len(t):
                    s, t = t, s
                if 100 * len(s) < percent * len(t):
                    continue
                at = np.searchsorted(t, s)
                common = int((t[np.minimum(at, len(t) - 1)] == s).sum())
                if 100 * common >= percent * (len(s) + len(t) - common):
                    root[max(p, q)] = min(p, q)
                    out.append((ids[x], ids[y]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    return run


def _block_pairs(own: DataFrame) -> DataFrame:
    """Rows of ``own(bucket, id, component)`` dealt to groups ``(bucket, i, j)`` that meet all pairs across components.

    Only members outside a bucket's largest component probe; they meet all members of the bucket,
    both sides in blocks of about ``BLOCK`` rows.  Buckets of one component drop out.
    """
    sizes = own.groupBy("bucket", "component").agg(F.count("*").alias("m"))
    split = (sizes.groupBy("bucket").agg(F.sum("m").alias("all"), F.max(F.struct("m", "component")).alias("top"))
             .where(F.col("all") > F.col("top.m"))
             .select("bucket", F.col("top.component").alias("major"), F.ceil(F.col("all") / BLOCK).cast("int").alias("nj"),
                     F.ceil((F.col("all") - F.col("top.m")) / BLOCK).cast("int").alias("ni")))
    rows = own.join(split, "bucket").withColumn("minor", F.col("component") != F.col("major"))
    up_to = "explode(sequence(0, {} - 1))"
    targets = rows.select("bucket", "id", "component", "minor", F.lit(False).alias("probe"),
                          F.expr(up_to.format("ni")).alias("i"), F.expr("pmod(hash(id), nj)").alias("j"))
    probes = rows.where("minor").select("bucket", "id", "component", "minor", F.lit(True).alias("probe"),
                                        F.expr("pmod(hash(id), ni)").alias("i"), F.expr(up_to.format("nj")).alias("j"))
    return targets.union(probes)


def _next_stars(own: DataFrame, step: int) -> tuple[DataFrame, int]:
    """Pairs ``(a, b)`` of members outside their bucket's main component with ``MEETS`` members of that, and of the next.

    Which members changes with the round; a document meets those of one bucket of each component.
    Also returns how many documents are left outside.
    """
    some = F.array_distinct(F.array(*(F.min_by("id", F.xxhash64("id", F.lit(step * MEETS + k))) for k in range(MEETS)))).alias("some")
    parts = saved(own.groupBy("bucket", "component").agg(F.count("*").alias("m"), some), "star-parts")
    largest = F.max(F.struct("m", "component", "some"))
    first = parts.groupBy("bucket").agg(largest.alias("main"), F.count("*").alias("c")).where("c > 1").drop("c")
    second = parts.join(first, "bucket").where(F.col("component") != F.col("main.component")).groupBy("bucket").agg(largest.alias("next"))
    left = own.join(first.join(second, "bucket"), "bucket").where(F.col("component") != F.col("main.component"))
    met = left.select("id", "component", F.explode(F.array("main", "next")).alias("other")).where(F.col("component") != F.col("other.component"))
    pairs = saved(met.groupBy("id", F.col("other.component").alias("c")).agg(F.min_by("other.some", F.xxhash64("id", "other.some")).alias("some"))
                  .select(F.col("id").alias("a"), F.explode("some").alias("b")), "star-pairs")
    return pairs, pairs.select("a").distinct().count()


def _joined_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after more links: whole components are joined, so only links between them count."""
    def of(end: str) -> DataFrame:
        return labels.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
    ends = (links.join(of("a"), "a", "left").join(of("b"), "b", "left")
            .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    joined = saved(connected_components(ends), "joined").toDF("component", "to")
    old = labels.join(joined, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    new = joined.join(labels.select(F.col("id").alias("component")), "component", "left_anti").select(F.col("component").alias("id"), F.col("to").alias("component"))
    return saved(old.unionByName(new), "labels")


def near_duplicates(docs: DataFrame, width: int = 2, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row of ``docs(doc_id, text)``; other columns are ignored.

    Words are runs without ASCII white space, A-Z lower-cased; a set holds the distinct
    ``width``-word shingles, or the whole sequence of a shorter text.  Documents are linked when
    100 * intersection >= ``percent`` * union; ``component_id`` is the smallest doc_id reachable
    and ``kept`` marks that document.  A null, empty or wordless text has no shingles and no
    links.  A row without doc_id has a null component and is not kept.  Repeated rows get equal
    results (several rows of the smallest doc_id are all marked as kept); rows that
    repeat a doc_id with another text count as linked with it.  An empty table gives none.
    """
    sig = saved(signatures(docs, width), "signatures")
    named = sig.where("id is not null")
    worded = named.where("n > 0")
    classes = saved(worded.groupBy("k1", "k2").agg(F.min("id").alias("rep")), "classes")
    reps = saved(worded.join(classes, ["k1", "k2"]).where("id = rep")
                 .select("id", "k1", "k2", "n", "bands", "bits").dropDuplicates(["id", "k1", "k2"]), "reps")
    spread = reps.select("id", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("hub")).where("n > 1")
    members = saved(spread.join(shared, "bucket"), "buckets").where("id <> hub")
    bits = reps.select("id", "bits", "n")
    star = (members.select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
            .join(bits.toDF("a", "x", "m"), "a").join(bits.toDF("b", "y", "n"), "b")
            .where((F.least("m", "n") < SMALL) | (agreement("x", "y") >= _lowest_agreement(percent / 100))).select("a", "b"))
    star = saved(star, "star")
    wanted = saved(members.select("id").union(members.select("hub")).distinct(), "wanted")
    full = shingle_sets(keep_keys(docs, wanted.withColumnRenamed("id", "doc_id"), ["doc_id"]), width)
    full = saved(full.join(reps.select("id", "k1", "k2"), ["id", "k1", "k2"]).dropDuplicates(["id", "k1", "k2"])
                 .select("id", "items"), "sets")
    links = saved(_linked(star, full, percent), "links")
    labels = saved(connected_components(links), "labels")

    def placed() -> DataFrame:
        return members.select("bucket", "id").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    step, linked, left = 1, 1, 1
    while linked * PAYS >= left > 0:
        pairs, left = _next_stars(saved(placed(), "placed"), step)
        near = (pairs.join(bits.toDF("a", "x", "m"), "a").join(bits.toDF("b", "y", "n"), "b")
                .where((F.least("m", "n") < SMALL) | (agreement("x", "y") >= _lowest_agreement(percent / 100))).select("a", "b"))
        found = saved(_linked(saved(near, "star"), full, percent), "links")
        linked = found.select("a").distinct().count()
        if linked:
            labels = _joined_labels(labels, found)
            links = links.union(found)
        step += 1
    own = placed()
    rest = saved(_block_pairs(own), "unsettled")
    if not rest.isEmpty():
        # one join brings a dealt row all that its block needs
        wide = saved(keep_keys(reps.select("id", "bands", "bits"), saved(rest.select("id").distinct(), "dealt"), ["id"]).join(full, "id"), "wide")
        more = (rest.join(wide, "id")
                .groupBy("bucket", "i", "j").applyInPandas(_across(percent), "a long, b long"))
        links = saved(links.union(more), "links")
        labels = saved(connected_components(links), "labels")

    rows = sig.select("id", "n", "k1", "k2").join(classes, ["k1", "k2"], "left")
    rows = rows.withColumn("rep", F.when(F.col("n") > 0, F.col("rep")))
    labelled = rows.join(labels.toDF("rep", "component"), "rep", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    return labelled.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
                           F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: that of the smallest doc_id.

    Rows without words or without doc_id stay.  Of rows that repeat the kept doc_id all stay.
    All columns are returned as they came.
    """
    found = near_duplicates(docs, width, percent)
    gone = saved(found.where("not kept and doc_id is not null").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
