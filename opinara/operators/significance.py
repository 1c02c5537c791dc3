"""Resampling tests on pooled correlations, with iterations spread over the cluster.

Shuffles and draws depend on the seed, the iteration and the subject alone, never on how rows
are partitioned, so a repeated task repeats its numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from opinara.operators.study import moments, pooled_r
from opinara.session import scratch_path


def _hash_key(*parts) -> Column:
    return F.md5(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]).cast("binary"))


def _packed_subjects(pairs: DataFrame) -> DataFrame:
    """Each subject's series as one row of demeaned arrays, as long as the calendar."""
    rows = Window.partitionBy("subject").orderBy("period")
    packed = (pairs.withColumn("idx", F.row_number().over(rows) - 1)
              .groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("idx", "x", "y"))).alias("s"))
              .filter(F.size("s") >= 3))
    mean = lambda f: F.aggregate("s", F.lit(0.0), lambda a, e: a + e[f]) / F.size("s")
    return (packed.withColumn("_mx", mean("x")).withColumn("_my", mean("y"))
            .select("subject", F.transform("s", lambda e: e["x"] - F.col("_mx")).alias("dx"),
                    F.transform("s", lambda e: e["y"] - F.col("_my")).alias("dy")))


#: Iterations that share one generator.  Fixed, so that the numbers drawn do not depend on how
#: the iterations are spread.
PER_GENERATOR = 64


def _sums_by_generator(work: DataFrame, iters: int, per_block: int, seed: int) -> DataFrame:
    """Shuffles from numpy's counter-based generator, keyed by (seed, subject, iteration // 64)."""
    def sums(batches):
        import numpy as np
        import pandas as pd
        for batch in batches:
            totals: dict[int, np.ndarray] = {}
            observed = np.zeros(3)
            for key, block, dx, dy in zip(batch["key"], batch["block"], batch["dx"], batch["dy"]):
                dx, dy = np.asarray(dx, float), np.asarray(dy, float)
                if block == 0:
                    observed += (dx @ dy, dx @ dx, dy @ dy)
                for first in range(block * per_block, min((block + 1) * per_block, iters), PER_GENERATOR):
                    n = min(PER_GENERATOR, iters - first)
                    rng = np.random.Generator(np.random.Philox(key=[(int(key) ^ seed) & (2**64 - 1), first // PER_GENERATOR]))
                    totals[first] = totals.get(first, 0.0) + rng.permuted(np.tile(dy, (n, 1)), axis=1) @ dx
            yield pd.DataFrame({"iter": [-1], "sxy": observed[0], "sxx": observed[1], "syy": observed[2]})
            for first, sxy in totals.items():
                yield pd.DataFrame({"iter": np.arange(first, first + len(sxy)), "sxy": sxy, "sxx": 0.0, "syy": 0.0})
    keyed = work.select(F.xxhash64("subject").alias("key"), "block", "dx", "dy")
    return keyed.mapInPandas(sums, "iter bigint, sxy double, sxx double, syy double")


def _sums_by_digest(work: DataFrame, iters: int, per_block: int, seed: int) -> DataFrame:
    """Shuffles ordered by MD5: slower, and reproducible by any engine that has MD5."""
    start = F.col("block") * per_block
    numbered = (work.withColumn("iter", F.explode(F.sequence(
        F.when(F.col("block") == 0, -1).otherwise(start), start + per_block - 1))).filter(F.col("iter") < iters))
    prefix = F.concat_ws(":", F.lit(str(seed)), F.col("iter").cast("string"), F.col("subject"), F.lit(""))
    shuffled = F.transform(F.array_sort(F.transform("dy", lambda v, i: F.struct(
        F.md5(F.concat(prefix, i.cast("string")).cast("binary")).alias("k"), v.alias("y")))), lambda h: h["y"])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    observed = F.col("iter") < 0
    return numbered.withColumn("shuffled", F.when(observed, F.col("dy")).otherwise(shuffled)).select(
        "iter", dot("dx", "shuffled").alias("sxy"), F.when(observed, dot("dx", "dx")).otherwise(0.0).alias("sxx"),
        F.when(observed, dot("dy", "dy")).otherwise(0.0).alias("syy"))


def _blocks_for(pairs: DataFrame, iters: int) -> tuple[int, int]:
    """Blocks of iterations, and partitions.  Both only spread the work; no number depends on them."""
    tasks = 4 * pairs.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, min(-(-iters // PER_GENERATOR), 16))
    return blocks, tasks


def permutation_test(pairs: DataFrame, iters: int, seed: int = 42, blocks: int | None = None,
                     method: str = "generator") -> DataFrame:
    """Two-sided permutation p of the pooled r; returns are shuffled within their subject.

    Shuffling changes neither sxx nor syy, so an iteration only needs sxy.  A subject's series
    is packed into one row and its iterations are spread as blocks; p is the same for any number
    of blocks, partitions and cores.  The number of partitions is fixed because the work lies in the iterations, not in the bytes.  What is
    exchanged between tasks is one partial sum per iteration and task.  Iteration -1 is the
    observed order, so one pass over the pairs gives both sides of the comparison.
    """
    sums_of = {"generator": _sums_by_generator, "digest": _sums_by_digest}[method]
    blocks, partitions = _blocks_for(pairs, iters) if blocks is None else (max(1, min(blocks, iters)), blocks)
    per_block = PER_GENERATOR * -(-iters // (blocks * PER_GENERATOR)) if method == "generator" else -(-iters // blocks)
    work = (_packed_subjects(pairs).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
            .repartition(partitions, "subject", "block"))
    per_iter = sums_of(work, iters, per_block, seed).groupBy("iter").agg(
        F.sum("sxy").alias("sxy"), F.sum("sxx").alias("sxx"), F.sum("syy").alias("syy"))
    observed = F.col("iter") < 0
    # One number per iteration: bounded by ``iters``.
    whole = per_iter.agg(F.max(F.when(observed, F.col("sxy"))).alias("sxy"),
                         F.max(F.when(observed, F.sqrt("sxx") * F.sqrt("syy"))).alias("scale"),
                         F.collect_list(F.when(~observed, F.col("sxy"))).alias("null"))
    r = F.try_divide("sxy", "scale")
    hits = F.size(F.filter("null", lambda v: F.abs(v / F.col("scale")) >= F.abs(F.col("r0")) - F.lit(1e-12)))
    return (whole.withColumn("r0", r)
            .select(F.coalesce("r0", F.lit(0.0)).alias("r"), F.lit(iters).alias("iters"),
                    F.when(F.col("r0").isNull(), 0).otherwise(hits).cast("bigint").alias("hits"), F.col("r0"))
            .withColumn("p", F.when(F.col("r0").isNull(), 1.0).otherwise((F.col("hits") + 1) / F.lit(iters + 1.0)))
            .drop("r0"))


def dense_index(df: DataFrame, key: str, buckets: int = 16_384) -> DataFrame:
    """Adds ``idx`` 0..n-1, a dense number per row with distinct ``key``.

    Rows are numbered inside hash buckets and shifted by the sizes of the buckets before; the
    only unpartitioned step runs over at most ``buckets`` counts.
    """
    bucketed = df.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(buckets)))
    counts = bucketed.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_b").orderBy(key)
    return (bucketed.withColumn("_i", F.row_number().over(inside) - 1).join(offsets, "_b")
            .withColumn("idx", F.col("_i") + F.col("_off")).drop("_b", "_i", "_off"))


def bootstrap_draws(spark: SparkSession, n_subjects: Column, iters: int, seed: int = 42) -> DataFrame:
    """``(iter, idx)``: as many draws with replacement per iteration as there are subjects."""
    slots = F.explode(F.sequence(F.lit(0).cast("bigint"), n_subjects - 1)).alias("slot")
    draw = F.conv(F.substring(_hash_key(seed, F.col("iter").cast("string"), F.col("slot").cast("string")), 1, 12),
                  16, 10).cast("bigint")
    return (spark.range(iters).select(F.col("id").alias("iter"), slots)
            .select("iter", F.pmod(draw, n_subjects).alias("idx")))


SUMS = ("n", "sxx", "syy", "sxy")

#: Fixed, as the numbers drawn depend on them: leaves of the tree of subject ranges at most, subjects a leaf
#: aims at and is walked by, and iterations that one task sums at a time.
MOST_LEAVES = 4_096
PER_CHUNK = 1_024
PER_GROUP = 64 * PER_GENERATOR


def _sums_by_numbers(subjects: DataFrame, iters: int, seed: int) -> DataFrame:
    """Draws numbered by MD5 meet the subjects' moments in a join: slower, and reproducible by any engine that has MD5."""
    n_subjects = subjects.agg(F.count(F.lit(1)).alias("n")).scalar()
    drawn = bootstrap_draws(subjects.sparkSession, n_subjects, iters, seed).join(subjects.select("idx", *SUMS), "idx")
    return drawn.groupBy("iter").agg(*[F.sum(c).alias(c) for c in SUMS])


def _chunks(batches):
    """``(group, leaf, values)`` of up to ``PER_CHUNK`` subjects of one leaf, cut alike however the rows are batched."""
    import numpy as np

    at, held = None, []

    def cut(rows, whole):
        size = len(rows) if whole else len(rows) - len(rows) % PER_CHUNK
        return [rows[i:i + PER_CHUNK] for i in range(0, size, PER_CHUNK)], rows[size:]
    for batch in batches:
        keys = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "leaf")])
        values = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in SUMS]).astype(float)
        borders = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
        for rows, key in zip(np.split(values, borders), keys[np.r_[0, borders]] if len(keys) else ()):
            if at is not None and tuple(key) != at:
                yield from ((*at, c) for c in cut(np.concatenate(held), True)[0])
                held = []
            at = tuple(map(int, key))
            done, rest = cut(np.concatenate([*held, rows]), False)
            yield from ((*at, c) for c in done)
            held = [rest]
    if at is not None:
        yield from ((*at, c) for c in cut(np.concatenate(held), True)[0])


def _drawn_counts(totals: list[int], iters: int, seed: int):
    """Function of a partition: sums per iteration of the moments times how often their subject is drawn.

    ``totals`` holds the subjects below each node of a binary tree (root 1, children 2i and 2i + 1).  Of a node's
    draws a binomial share falls on its left child, by a generator that only (seed, block of iterations, node)
    name; so every task finds the draws of its leaves by walking down from the root.
    """
    leaves = len(totals) // 2

    def generators(first, n, node):
        import numpy as np
        return [np.random.Generator(np.random.Philox(key=[seed & (2**64 - 1), (b << 32) | node]))
                for b in range(first // PER_GENERATOR, -(-(first + n) // PER_GENERATOR))]

    def parts(values):
        return [values[i:i + PER_GENERATOR] for i in range(0, len(values), PER_GENERATOR)]

    def share(rngs, draws, part, whole):
        import numpy as np
        if part == whole:
            return draws
        return np.concatenate([g.binomial(d, part / whole) for g, d in zip(rngs, parts(draws))])

    def sums(batches):
        import numpy as np
        import pyarrow as pa

        def emit(first, total):
            return pa.RecordBatch.from_arrays(
                [pa.array(np.arange(first, first + len(total))), *(pa.array(c) for c in total.T)], ["iter", *SUMS])
        group = leaf = None
        for grp, at, values in _chunks(batches):
            if grp != group:
                if group is not None:
                    yield emit(group * PER_GROUP, total)
                n = min(PER_GROUP, iters - grp * PER_GROUP)
                group, leaf, total = grp, None, np.zeros((n, len(SUMS)))
                path = {1: np.full(n, totals[1], dtype=np.int64)}
            first = group * PER_GROUP
            if at != leaf:
                leaf, node = at, leaves + at
                steps = [node >> i for i in range(node.bit_length() - 1, -1, -1)]
                path = {s: path[s] for s in steps if s in path}
                for parent, child in zip(steps, steps[1:]):
                    if child not in path:
                        left = share(generators(first, n, parent), path[parent], totals[2 * parent], totals[parent])
                        path[child] = left if child % 2 == 0 else path[parent] - left
                draws, subjects, rngs = path[node], totals[node], generators(first, n, node)
            here = share(rngs, draws, len(values), subjects)
            draws, subjects = draws - here, subjects - len(values)
            done = 0
            for rng, counts in zip(rngs, parts(here)):
                size = len(values)
                slots = np.repeat(np.arange(len(counts)) * size, counts) + rng.integers(0, size, counts.sum())
                times = np.bincount(slots, minlength=len(counts) * size).reshape(-1, size)
                total[done:done + len(counts)] += times @ values
                done += len(counts)
        if group is not None:
            yield emit(group * PER_GROUP, total)
    return sums


def drawn_sums(subjects: DataFrame, iters: int, seed: int = 42) -> DataFrame:
    """No draw is a row: how often a subject is drawn comes from binomials split down a tree of subject ranges.

    The counts of an iteration are exactly multinomial and depend on seed, iteration and subjects alone.  A subject's
    moments travel once per 4,096 iterations, then one sum per iteration and task.
    """
    bucketed = subjects.withColumn("leaf", F.pmod(F.xxhash64("subject"), F.lit(MOST_LEAVES)).cast("int"))
    sizes = [0] * MOST_LEAVES
    for r in bucketed.groupBy("leaf").count().collect():  # at most MOST_LEAVES rows
        sizes[r["leaf"]] = r["count"]
    leaves = 1
    while leaves < MOST_LEAVES and leaves * PER_CHUNK < sum(sizes):
        leaves *= 2
    width = MOST_LEAVES // leaves
    totals = [0] * leaves + [sum(sizes[i:i + width]) for i in range(0, MOST_LEAVES, width)]
    for node in range(leaves - 1, 0, -1):
        totals[node] = totals[2 * node] + totals[2 * node + 1]
    groups = F.sequence(F.lit(0), F.lit(max(0, -(-iters // PER_GROUP) - 1)))
    work = (bucketed.select(F.explode(groups).alias("grp"), F.floor(F.col("leaf") / width).cast("int").alias("leaf"), "subject", *SUMS)
            .repartition("grp", "leaf").sortWithinPartitions("grp", "leaf", "subject").select("grp", "leaf", *SUMS))
    drawn = work.mapInArrow(_drawn_counts(totals, iters, seed), "iter bigint, " + ", ".join(f"{c} double" for c in SUMS))
    return drawn.groupBy("iter").agg(*[F.sum(c).alias(c) for c in SUMS])


def bootstrap_ci(spark: SparkSession, pairs: DataFrame, iters: int, seed: int = 42,
                 low: float = 0.025, high: float = 0.975, indexed: DataFrame | None = None,
                 method: str = "generator") -> DataFrame:
    """Nearest-rank interval of the pooled r over subjects drawn with replacement.

    ``generator`` draws counts per subject, ``digest`` draws single subject numbers by MD5, over ``indexed`` moments
    if they are given.  (0, 0) when no iteration gives an r.
    """
    if indexed is not None:
        per_iter = _sums_by_numbers(indexed, iters, seed)
    else:
        # One short row per subject, read more than once below: written instead of recomputed.
        per_subject = moments(pairs, ["subject"]).filter("n >= 3")
        path = scratch_path(spark, "moments")
        per_subject.write.parquet(path)
        subjects = spark.read.schema(per_subject.schema).parquet(path)
        per_iter = {"generator": lambda: drawn_sums(subjects, iters, seed),
                    "digest": lambda: _sums_by_numbers(dense_index(subjects, "subject"), iters, seed)}[method]()
    rs = per_iter.select(pooled_r(F.col("sxx"), F.col("syy"), F.col("sxy"), F.col("n")).alias("r")).filter("r is not null")
    # One number per iteration: bounded by ``iters``.
    ordered = rs.agg(F.array_sort(F.collect_list("r")).alias("rs"))
    pick = lambda q: F.coalesce(F.get("rs", F.floor(F.lit(q) * F.size("rs")).cast("int")), F.lit(0.0))
    return ordered.select(pick(low).alias("ci_low"), pick(high).alias("ci_high"), F.size("rs").alias("iters"))
