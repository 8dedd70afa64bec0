"""Connected components by alternating star contraction, as joins and minimum aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least id reachable from each node of ``edges`` (u, v), for nodes that are not the least themselves.

    Every round writes its edges to the shared folder. A node with very many neighbours is only ever aggregated by partial
    minima or joined to one row; the minima are written first, so that adaptive execution can split the other side.
    """
    pairs = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while (now := _mark(pairs)) != before:
        before = now
        if not now[0]:
            break
        # large star: larger neighbours hang on the least of the neighbourhood
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large)
        # small star: smaller neighbours and the node itself hang on the least
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        pairs = materialize(small.where("u <> v").distinct())
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))


def numbered(nodes: DataFrame) -> DataFrame:
    """Adds ``node``, a number of its own for each row; fixed once the table is written."""
    return nodes.withColumn("node", F.monotonically_increasing_id())


def least_ids(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Adds ``component`` and ``component_id``, the least ``rep`` in it, to (node, rep, ...); found: (node, component)."""
    placed = materialize(nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")))
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return materialize(placed.join(materialize(least), "component", "left").withColumn("component_id", F.coalesce("component_id", "rep")))
