"""Connected components of an undirected graph given as edges.

Alternating large-star and small-star steps (Kiveris et al., 2014): each step
moves edges towards the smallest node in reach, and the edges end as stars
around the smallest node of each component, after few rounds whatever the
length of the paths.  A step is one partial minimum per node and one join on
the node, so a hub with a third of all edges ships one partial row per task
and its join partition is split at run time.  Each round is pinned in the
shared folder; nothing but two numbers per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pin


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Expects u > v in every edge (as large-star leaves them)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def component_roots(edges: DataFrame) -> DataFrame:
    """``u, v`` long edges -> ``node, root``: the smallest node reachable, for
    every node that is not its own root.  No edges: no rows."""
    now = pin(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        sign = now.agg(F.count(F.lit(1)).alias("n"),
                       F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if sign.n == 0 or tuple(sign) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(sign)
        now = pin(_small_star(_large_star(now)))
