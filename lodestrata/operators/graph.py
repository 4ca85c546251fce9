"""Bounded graph walks over edges (src, pred, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize


def neighbours(edges: DataFrame, start: DataFrame, depth: int, fan_out: int = 25, limit: int = 250) -> DataFrame:
    """Breadth-first levels from ``start`` (node): at most ``fan_out`` edges per node and direction.

    Every level ranks its edges per (node, direction) by the neighbour, keeps one
    row per neighbour ('in' before 'out') and drops nodes of earlier levels. The
    bounds are the operator's own: they limit a hub's share of the answer.
    """
    depth = max(0, min(depth, 3))
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"), F.lit("out").alias("direction"), "pred")
    into = edges.select(F.col("dst").alias("node"), F.col("src").alias("next"), F.lit("in").alias("direction"), "pred")
    both = out.unionByName(into)
    found = start.select("node", F.lit(0).alias("depth"), F.lit("self").alias("direction"), F.lit("SELF").alias("pred"))
    frontier = start.select("node")
    for level in range(1, depth + 1):
        per = Window.partitionBy("node", "direction").orderBy("next", "pred")
        reached = both.join(frontier, "node", "left_semi").withColumn("k", F.row_number().over(per)).where(F.col("k") <= fan_out)
        fresh = reached.groupBy("next").agg(F.min(F.struct("direction", "pred")).alias("edge"))
        # Written once a level, so that no level computes the ones before it again.
        fresh = materialize(fresh.select(F.col("next").alias("node"), F.lit(level).alias("depth"), "edge.direction", "edge.pred").join(found, "node", "left_anti"), "level")
        frontier = fresh.select("node")
        found = found.unionByName(fresh)
    return found.orderBy("depth", "node").limit(max(1, min(limit, 250)))


def simple_paths(edges: DataFrame, start: DataFrame, depth: int, predicates: list[str] | None = None) -> DataFrame:
    """Every simple undirected path of 1 to ``depth`` (3 at most) edges, one row each."""
    e = edges if predicates is None else edges.where(F.col("pred").isin(predicates[:50]))
    both = e.select(F.col("src").alias("node"), F.col("dst").alias("next")).unionByName(e.select(F.col("dst").alias("node"), F.col("src").alias("next")))
    level = start.select("node", F.array("node").alias("path"))
    found = None
    for d in range(1, max(1, min(depth, 3)) + 1):
        level = level.join(both, "node").where(~F.array_contains("path", F.col("next"))).select(F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"))
        one = level.select("node", "path", F.lit(d).alias("depth"))
        found = one if found is None else found.unionByName(one)
    return found


def closure(parents: DataFrame, depth: int = 4) -> DataFrame:
    """(ancestor, node, distance) pairs of a hierarchy (node, parent), the shortest distance kept, itself included."""
    level = parents.select(F.col("node").alias("ancestor"), "node").distinct().withColumn("distance", F.lit(0))
    found = level
    for d in range(1, depth + 1):
        up = parents.select(F.col("node").alias("ancestor"), F.col("parent").alias("up"))
        level = level.join(up, "ancestor").where("up IS NOT NULL").select(F.col("up").alias("ancestor"), "node", F.lit(d).alias("distance"))
        found = found.unionByName(level)
    return found.groupBy("ancestor", "node").agg(F.min("distance").alias("distance"))
