"""Connected components of an edge table, as Spark jobs.

Alternating stars: every round links each node's larger neighbours to its
smallest neighbour, then each node and its smaller neighbours to the smallest
of them. Both only move links between nodes of one component, and end in one
star per component, centred on its smallest node.

A node with very many links is no hot key: minima are aggregated before the
shuffle, and the joins that hand them back read checkpointed sides, so Spark
can split a large partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _smallest(edges: DataFrame) -> DataFrame:
    """The smallest neighbour ``m`` of every node ``u``."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).checkpoint()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root``: every node that has a link to another one, and the
    smallest node of its component (a root is listed with itself).

    ``edges`` has columns ``u, v`` of one orderable type; direction, repeats,
    loops (``u = v``) and rows with a null end don't matter. An empty table
    gives an empty result.
    """
    links = (edges.where(F.col("u") != F.col("v"))
             .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint())
    state = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _smallest(both).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().checkpoint())
        low = _smallest(large)
        small = (large.join(low, "u").where(F.col("v") != F.col("m"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        links = small.union(low.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        # a sum that no order changes; equal twice in a row: nothing moved
        before, state = state, links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == state:
            break
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
