"""Connected components of an edge table, without collecting any of it.

Alternates two steps until no edge changes: every node hooks its larger
neighbours to its smallest one, then every smaller neighbour likewise (the star
contraction of Kiveris et al., "Connected Components in MapReduce and Beyond").
A node's smallest neighbour is an aggregate, so a hub is never gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.storage import discard, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if large:  # smallest of a node and its neighbours, to each larger neighbour
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # among a node and its smaller neighbours
        down = both.where("v < u")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.union(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node that an edge (u, v) names; component is its smallest node.

    Self-links and repeated links are allowed; a node with only links to itself is not returned.
    """
    links = materialise(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    mark = None
    for _ in range(rounds):
        after = materialise(_star(_star(links, True), False), "links")
        seen = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(links)
        links = after
        if seen == mark:
            roots = links.select("v").distinct()
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("v", "v"))
        mark = seen
    raise RuntimeError(f"components did not settle in {rounds} rounds")
