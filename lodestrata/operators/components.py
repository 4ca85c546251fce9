"""Connected components of an edge list by alternating large-star and small-star steps.

Every step is two aggregations and two joins over the edges, so hot nodes are
pre-aggregated before the shuffle and split by adaptive skew joins. Each round
is written to the shared folder. Nothing but two counters reaches the driver.

Rounds are bounded: Kiveris et al. (2014) prove O(log^2 n) rounds and observe
about log n for a graph of n nodes; ``max_rounds`` is far above that for any
number of nodes that a long can name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """node long, component long (the smallest node reachable) for every node of ``edges`` (a long, b long)."""
    current = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a")
        current = materialize(
            small.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b"))).where("a <> b").distinct(),
            "edges",
        )
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # Settled edges are stars: every node points at its component's smallest node.
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
