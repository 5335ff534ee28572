"""Connected components of an edge table, by alternating large-star and small-star steps.

Only joins, grouping and union of DataFrames; each round is checkpointed. Minima are combined before their
shuffle. Nodes of many edges are split off in the joins: the minima of the 2 * HUBS of them that there can be
are broadcast, so that a component holding a third of all nodes does not land in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: A hub has more edges than HUB and than one in HUBS of all.
HUB, HUBS = 64, 2048


def _large_star(edges: DataFrame, hub: float) -> DataFrame:
    """Every larger neighbour v of u is moved to the least of u and its neighbours.

    Nodes u of more than hub edges don't meet in one task: their minima are broadcast.
    """
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    hubs = F.broadcast(least.filter(F.col("n") > hub).select("u", "m"))
    up = both.filter(F.col("v") > F.col("u"))
    rest = up.join(hubs, "u", "left_anti").join(least.select("u", "m"), "u")
    return up.join(hubs, "u").unionByName(rest).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are moved to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    """Equal for equal edge sets: their number and two sums over hashes of the edges."""
    low, high = F.xxhash64("u", "v").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.xxhash64("u", "v"), 32)
    row = edges.agg(F.count(F.lit(1)), F.sum(low), F.sum(high)).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (two columns of one ordered type): root is the least node it reaches.

    Repeated edges, loops and either direction are allowed; edges with a null end are left out. A node
    that only has loops is returned as its own root. An empty table gives an empty result.
    """
    named = edges.toDF("u", "v").filter(F.col("u").isNotNull() & F.col("v").isNotNull())
    named = checkpoint(named.distinct())
    links = named.filter(F.col("u") != F.col("v"))
    state = _state(links)
    while state[0]:
        # Each edge counts at both of its nodes, so at most 2 * HUBS nodes are beyond this.
        hub = max(HUB, state[0] / HUBS)
        links = checkpoint(_small_star(checkpoint(_large_star(links, hub))))
        now = _state(links)
        if now == state:
            break
        state = now
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root"))
    alone = named.filter(F.col("u") == F.col("v")).select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(roots).union(alone).groupBy("node").agg(F.min("root").alias("root"))
