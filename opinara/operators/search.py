"""Cosine search: exact top-k, per-subject batches, and an inverted-file layout."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from opinara.operators.records import for_subject, with_embedding

EPSILON = 1e-9

# Batch search: rows of a cell's items and queries that meet in one group, and queries multiplied at once.
ITEM_BLOCK, QUERY_BLOCK, QUERIES_AT_ONCE = 8192, 4096, 256
# More than the rounding error of a product of unit vectors.
MARGIN = 1e-9


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Fixed-length list column as a float64 matrix, without a Python loop over rows."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 1)


def _unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / (np.linalg.norm(matrix, axis=-1, keepdims=True) + EPSILON)


def cosine_to(query: list[float]):
    """Arrow function: similarity of a vector column to one query vector (a small constant)."""
    unit_query = _unit(np.asarray(query, dtype=np.float64))

    @F.arrow_udf(T.DoubleType())
    def similarity(vectors: pa.Array) -> pa.Array:
        return pa.array(_unit(_matrix(vectors)) @ unit_query)
    return similarity


@F.arrow_udf(T.DoubleType())
def cosine_pairs(left: pa.Array, right: pa.Array) -> pa.Array:
    """Row-wise similarity of two vector columns."""
    return pa.array(np.einsum("ij,ij->i", _unit(_matrix(left)), _unit(_matrix(right))))


def cosine_expr(left: Column | str, right: Column | str) -> Column:
    """The same measure without Python, for short vectors or few rows."""
    left, right = (F.col(c) if isinstance(c, str) else c for c in (left, right))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                                   F.lit(0.0), lambda s, v: s + v)
    norm = lambda a: F.sqrt(dot(a, a)) + F.lit(EPSILON)
    return dot(left, right) / (norm(left) * norm(right))


def semantic_search(items: DataFrame, query: list[float], k: int = 200, subject: str | None = None) -> DataFrame:
    """The k most similar items, best first, ties by id.

    Only the vector column goes through Arrow, the others stay in the JVM; the bounded top-k
    keeps k rows per partition, so no full sort and no shuffle of the corpus happens.
    """
    scope = with_embedding(for_subject(items, subject))
    scored = scope.withColumn("similarity", cosine_to(query)("embedding")).drop("embedding")
    return scored.orderBy(F.desc("similarity"), "external_id").limit(k)


def search_many(items: DataFrame, queries: DataFrame, k: int = 200) -> DataFrame:
    """Top k per query row ``(query_id, subject, query_vector)``, each within its own subject.

    An equi-join on subject; the planner broadcasts the query side only if it measures small,
    and the rank bound is applied per partition ahead of the shuffle on the query.
    """
    joined = with_embedding(items).join(queries, "subject")
    scored = joined.withColumn("similarity", cosine_pairs("embedding", "query_vector")).drop("embedding", "query_vector")
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "external_id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


# --- inverted file ------------------------------------------------------------------------------
def train_cells(items: DataFrame, lists: int = 100, seed: int = 42, iterations: int = 10,
                sample: int = 100_000) -> list[list[float]]:
    """Cell centres by distributed k-means on unit vectors; ``lists`` short vectors.

    Trained on about ``sample`` items, chosen by a hash of id and vector, all items if there are fewer; the index
    covers every item.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    scope = with_embedding(items)
    total = scope.count()
    if total > sample:
        scope = scope.filter(F.pmod(F.xxhash64("external_id", "embedding"), F.lit(total)) < sample)
    vectors = scope.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    unit = Normalizer(inputCol="v", outputCol="features", p=2.0).transform(vectors).select("features").cache()
    try:
        model = KMeans(k=lists, seed=seed, maxIter=iterations, initSteps=2).fit(unit)
        return [list(map(float, c)) for c in model.clusterCenters()]
    finally:
        unit.unpersist()


def _cell_of(centres: list[list[float]]):
    unit_centres = _unit(np.asarray(centres, dtype=np.float64))

    @F.arrow_udf(T.IntegerType())
    def nearest(vectors: pa.Array) -> pa.Array:
        return pa.array(np.argmax(_unit(_matrix(vectors)) @ unit_centres.T, axis=1), type=pa.int32())
    return nearest


def _nearest_cells(centres: list[list[float]], n: int):
    unit_centres = _unit(np.asarray(centres, dtype=np.float64))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def nearest(vectors: pa.Array) -> pa.Array:
        order = np.argsort(-(_unit(_matrix(vectors)) @ unit_centres.T), axis=1, kind="stable")[:, :n].astype(np.int32)
        borders = np.arange(len(order) + 1, dtype=np.int32) * order.shape[1]
        return pa.ListArray.from_arrays(pa.array(borders), pa.array(order.ravel()))
    return nearest


def assign_cells(items: DataFrame, centres: list[list[float]]) -> DataFrame:
    return with_embedding(items).withColumn("cell", _cell_of(centres)("embedding"))


def _laid_out(items: DataFrame, centres: list[list[float]], copies: int) -> DataFrame:
    if copies == 1:
        return assign_cells(items, centres).hint("rebalance", "cell")
    near = with_embedding(items).withColumn("cells", _nearest_cells(centres, copies)("embedding"))
    return near.withColumn("cell", F.explode("cells")).hint("rebalance", "cell")


def write_index(items: DataFrame, centres: list[list[float]], path: str, copies: int = 1) -> None:
    """Items laid out by cell, so that a search reads only the folders it probes.

    With ``copies`` an item lies in its nearest cells, all named in ``cells``: more disk for fewer probes.
    """
    _laid_out(items, centres, copies).write.mode("overwrite").partitionBy("cell").parquet(path)


def add_to_index(items: DataFrame, centres: list[list[float]], path: str, copies: int = 1) -> None:
    """New items join the folders of their cells; what is there stays untouched."""
    _laid_out(items, centres, copies).write.mode("append").partitionBy("cell").parquet(path)


def _met_once(index: DataFrame, probed: Column) -> DataFrame:
    """A copied item counts in the first of its cells that is probed, so that no copies need to meet."""
    if "cells" not in index.columns:
        return index
    return index.filter(F.get(F.filter("cells", lambda c: F.array_contains(probed, c)), F.lit(0)) == F.col("cell")).drop("cells")


def probe_cells(centres: list[list[float]], query: list[float], probes: int) -> list[int]:
    closeness = _unit(np.asarray(centres)) @ _unit(np.asarray(query, dtype=np.float64))
    return [int(i) for i in np.argsort(-closeness, kind="stable")[:probes]]


def match_items(index: DataFrame, centres: list[list[float]], query: list[float], k: int = 200,
                subject: str | None = None, probes: int = 10) -> DataFrame:
    """Approximate top-k: the nearest ``probes`` cells, ranked exactly."""
    cells = probe_cells(centres, query, probes)
    probed = _met_once(index.filter(F.col("cell").isin(cells)), F.array(*map(F.lit, cells)))
    return semantic_search(probed, query, k, subject)


def match_many(index: DataFrame, centres: list[list[float]], queries: DataFrame, k: int = 200, probes: int = 10) -> DataFrame:
    """Approximate top k per query row ``(query_id, query_vector)`` in one job; within its subject if queries have one.

    Queries are exploded to their nearest ``probes`` cells and meet the items of those: in blocks, where only the k best
    of a query become rows, or, within subjects, in an equi-join.  Only folders that some query probes are read: their
    numbers and counts, at most one row per centre, are asked for first.  A query without a vector finds nothing.
    Ranks are bounded per partition ahead of the shuffle on the query.
    """
    asked = (queries.filter(F.size("query_vector") > 0).withColumn("_probed", _nearest_cells(centres, probes)("query_vector"))
             .withColumn("cell", F.explode("_probed")))
    asks = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}
    items = index.filter(F.col("cell").isin(sorted(asks)))
    if probes >= len(centres) and "cells" in index.columns:
        items = items.filter(F.get("cells", F.lit(0)) == F.col("cell")).drop("cells")
    if "subject" in queries.columns:
        joined = _met_once(items.join(asked, ["cell", "subject"]), F.col("_probed")).drop("_probed")
        scored = joined.withColumn("similarity", cosine_pairs("embedding", "query_vector")).drop("embedding", "query_vector")
    else:
        scored = _met_once(_best_of_blocks(items, asked, asks, k), F.col("_probed")).drop("_probed")
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "external_id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _best_of_blocks(items: DataFrame, asked: DataFrame, asks: dict[int, int], k: int) -> DataFrame:
    """The k best items of each query in each block of a cell that it probes.

    Items and queries of a cell are dealt evenly to blocks, and any two blocks meet in one group: memory is bounded by
    the sizes of blocks.  Items that do not count in this cell may be among the k, but all of them count in another
    probed one, so none of the k best over all cells is left out.
    """
    held = {r["cell"]: r["count"] for r in items.groupBy("cell").count().collect()}

    def blocks(counts: dict[int, int], size: int) -> Column:
        numbers = [max(1, -(-counts.get(c, 0) // size)) for c in range(max(asks, default=0) + 1)]
        return F.get(F.lit(numbers), F.col("cell")).cast("bigint")

    def every(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))

    of_items, of_queries = blocks(held, ITEM_BLOCK), blocks(asks, QUERY_BLOCK)
    left = items.withColumn("_items", F.pmod(F.monotonically_increasing_id(), of_items)).withColumn("_queries", every(of_queries))
    right = (asked.withColumn("_queries", F.pmod(F.xxhash64("query_id", "query_vector"), of_queries))
             .withColumn("_items", every(of_items)))
    keys = ["cell", "_items", "_queries"]
    kept = ["cell"] + [c for c in items.columns if c not in ("cell", "embedding")]
    asking = [c for c in asked.columns if c not in ("cell", "query_vector")]
    schema = T.StructType([T.StructField(c, side.schema[c].dataType) for side, names in ((items, kept), (asked, asking)) for c in names]
                          + [T.StructField("similarity", T.DoubleType())])
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_block_pair(kept, asking, k), schema)


def _block_pair(kept: list[str], asking: list[str], k: int):
    """Arrow function of a block of items and one of queries."""
    def best(items: pa.Table, queries: pa.Table) -> pa.Table:
        items = items.take(pc.sort_indices(items, sort_keys=[("external_id", "ascending")], null_placement="at_start"))
        picked = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if items.num_rows and queries.num_rows:
            items = items.take(pa.array(_first_copies(_matrix(items["embedding"]), k)))
            unit_items, unit_queries = _unit(_matrix(items["embedding"])), _unit(_matrix(queries["query_vector"]))
            for at in range(0, len(unit_queries), QUERIES_AT_ONCE):
                query, item, similarity = _k_best(unit_queries[at:at + QUERIES_AT_ONCE], unit_items, k)
                picked.append((query + at, item, similarity))
        query, item, similarity = (np.concatenate(part) for part in zip(*picked))
        found, of = items.select(kept).take(pa.array(item)), queries.select(asking).take(pa.array(query))
        return pa.table([*found.columns, *of.columns, pa.array(similarity)], names=[*kept, *asking, "similarity"])
    return best


def _first_copies(matrix: np.ndarray, k: int) -> np.ndarray:
    """Rows but for those with k equal ones before them; equal vectors tie, so no query needs more."""
    _, group = np.unique(matrix.view(np.dtype((np.void, matrix.itemsize * matrix.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(group, kind="stable")
    group = group[order]
    return np.sort(order[np.arange(len(order)) - np.searchsorted(group, group) < k])


def _k_best(queries: np.ndarray, items: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of query and item and the similarity of each query's k best unit vectors, ties by the item's number.

    One matrix product finds them up to its rounding error; those within MARGIN of the k-th are measured as
    ``cosine_pairs`` does, which decides.  NaN ranks first, as in Spark.
    """
    near = queries @ items.T
    near[np.isnan(near)] = np.inf
    least = len(items) - k
    floor = np.partition(near, least, axis=1)[:, least, None] - MARGIN if 0 <= least < len(items) else -np.inf
    query, item = np.nonzero(near >= floor)
    similarity = np.zeros(len(query))
    for at in range(0, len(query), ITEM_BLOCK):
        some = slice(at, at + ITEM_BLOCK)
        similarity[some] = np.einsum("ij,ij->i", queries[query[some]], items[item[some]])
    order = np.lexsort((item, -np.where(np.isnan(similarity), np.inf, similarity), query))
    query, item, similarity = query[order], item[order], similarity[order]
    first = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[first], item[first], similarity[first]
