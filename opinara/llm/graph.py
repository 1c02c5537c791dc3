"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _downwards(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger to its smaller end; no loops."""
    return (edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .where("a <> b").distinct())


def _parents(edges: DataFrame) -> DataFrame:
    """The root that each node reaches by going to its smallest neighbour again and again."""
    parent = saved(edges.groupBy("a").agg(F.min("b").alias("p")), "parents")
    while True:
        up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        jumped = saved(parent.join(up, "p", "left").select("a", F.coalesce("pp", "p").alias("p"),
                                                           F.col("pp").isNotNull().alias("moved")), "jumped")
        parent = jumped.select("a", "p")
        if jumped.where("moved").isEmpty():
            return parent


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every end of ``edges(a, b)``; ``component`` is the smallest id reachable.

    Every level hooks each node to its smallest neighbour, follows those hooks to their roots by
    doubling, and goes on with the edges between roots, which are fewer each time.  Hot nodes
    only meet in minima (partial aggregates) and equi-joins.  Null ends are ignored; an empty
    edge list gives an empty result.
    """
    edges = saved(_downwards(edges.where("a is not null and b is not null")), "edges")
    ids = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    levels = []
    while not edges.isEmpty():
        parent = _parents(edges)
        levels.append(parent)
        lower = parent.select(F.col("a").alias("b"), F.col("p").alias("q"))
        edges = saved(_downwards(edges.join(parent, "a").join(lower, "b", "left")
                                 .select(F.col("p").alias("a"), F.coalesce("q", "b").alias("b"))), "edges")
    labels = ids.withColumn("component", F.col("id"))
    for parent in levels:
        labels = (labels.join(parent.withColumnRenamed("a", "component"), "component", "left")
                  .select("id", F.coalesce("p", "component").alias("component")))
    return labels
