"""Connected components of an edge list, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilark.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """``edges``: u, v (long). One row a node that has an edge: node, component (the smallest
    node reachable). Each round takes the minimum over the neighbours (partial minima before
    the shuffle), then follows each label once; rounds grow with the logarithm of the longest
    chain. Nothing but a count of changed labels reaches the driver."""
    both = saved(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct())
    label = saved(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("l")))
    while True:
        near = both.join(label.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("l").alias("m"))
        hop = label.join(near, "node").select("node", "l", F.least("l", "m").alias("m"))
        jump = label.select(F.col("node").alias("m"), F.col("l").alias("up"))
        new = saved(hop.join(jump, "m", "left").select("node", "l", F.least("m", F.coalesce("up", "m")).alias("m")))
        changed = new.filter("m < l").limit(1).count()
        label = new.select("node", F.col("m").alias("l"))
        if not changed:
            return label.select("node", F.col("l").alias("component"))
