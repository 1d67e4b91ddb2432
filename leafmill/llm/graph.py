"""Connected components by alternating large-star and small-star steps.

Each step takes the least neighbour of a node by an aggregate and joins it back; edges of nodes with many
neighbours are spread over the tasks.  Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, looked_up, written


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b); root is the least node of its component."""
    u, v = F.col("u"), F.col("v")
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = written(down, "edges")
    n, mark = now.count(), None
    while True:
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
        met = looked_up(both.where(v > u), least, "u", "m", "v", 2 * n)
        large = written(met.select(v.alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        pairs = looked_up(large, least, "u", "m", "v", 2 * n)
        small = pairs.select(v.alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, now = now, written(small, "small-star")
        dropped(before, large)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        n, mark = seen[0], seen
    roots = now.select(u.alias("node"), v.alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
