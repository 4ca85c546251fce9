"""Rasters made of the parts' and orders' numbers: skeletons, and tiles read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import skeleton
from ..sources import tiles
from ..sources.tables import load
from .registry import query


def strokes(spark, sf):
    """x, y: a thick stroke for each part, on a raster as wide as the parts are many."""
    p = load(spark, sf, "part").select((F.col("p_partkey") * 7).alias("x0"), (F.col("p_partkey") * 31 % 60).alias("y0"), (F.col("p_size") % 3 - 1).alias("slope"), (F.col("p_size") % 2 + 2).alias("half"))
    along = p.select("*", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("t"))
    wide = along.select("*", F.explode(F.sequence(-F.col("half"), F.col("half"))).alias("d"))
    return wide.select((F.col("x0") + F.col("t")).alias("x"), (F.col("y0") + F.col("slope") * F.col("t") + F.col("d")).alias("y"))


@query()
def skeleton_lines(spark, sf):
    """No SQL: rounds of thinning and pruning; tested against the whole raster and a plain sequence."""
    lines = skeleton.pruned_words(skeleton.thinned_words(skeleton.packed(strokes(spark, sf)), 1024, 64), 8.0, 1024)
    return skeleton.word_graph(lines, 1024).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round("length", 6).alias("length"))


@query("""WITH c AS (SELECT o_custkey - 300 AS x, o_orderkey % 700 - 50 AS y, max(round(o_totalprice / 7)) / 10 AS z FROM orders WHERE o_orderkey % 9 <> 4 GROUP BY ALL)
SELECT x, y, round(z, 4) AS z FROM c""")
def tile_cells(spark, sf):
    o = load(spark, sf, "orders").where("o_orderkey % 9 <> 4")
    cells = o.groupBy((F.col("o_custkey") - 300).alias("x"), (F.col("o_orderkey") % 700 - 50).alias("y")).agg((F.max(F.round(F.col("o_totalprice") / 7)) / 10).alias("z"))
    return tiles.cells_of(tiles.tiles(cells, -1000.0, 10.0), -1000.0, 10.0).select("x", "y", F.round("z", 4).alias("z"))
