"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One half round over (a, b) with a > b.

    Large: every node links its larger neighbours to the least of its neighbourhood. Small: every node links itself and
    its smaller neighbours to the least of them. The minimum is pre-aggregated before its shuffle, and the join with it
    can be split by AQE where one node holds many links.
    """
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    both = near.join(least, "u")
    if large:
        return both.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    # u's own link to its least neighbour comes with the minimum table; the others move
    moved = both.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.filter("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the least node that it reaches. Nodes are longs.

    Null ends and loops are ignored; repeated links count once; an empty table gives an empty result. Each round is a
    written table, so that a lost executor costs one round at most; the driver sees a count and a checksum alone.
    """
    edges = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, seen = cut(edges, "links"), None
    while True:
        state = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if state == seen or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = state
        edges = cut(_star(_star(edges, True), False), "links")
