"""Surfaces through the customers' places: quadratic fits a group of nations, masked by each group's hull."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import surfaces
from ..sources.tables import load
from .registry import query


def points(spark, sf):
    c = load(spark, sf, "customer")
    x, y = F.col("c_custkey") * 37 % 101 / 10.0, F.col("c_custkey") * 53 % 89 / 10.0
    z = 3 + 2 * x - y + 0.5 * x * x - 0.25 * x * y + 0.125 * y * y
    return c.select("c_custkey", (F.col("c_nationkey") % 5).cast("long").alias("key"), x.alias("x"), y.alias("y"), z.alias("z"))


@query("""WITH p AS (SELECT c_custkey, c_nationkey % 5 AS key, c_custkey * 37 % 101 / 10.0 AS x, c_custkey * 53 % 89 / 10.0 AS y FROM customer), n AS (SELECT key FROM p GROUP BY key HAVING count(DISTINCT (x, y)) > 12)
SELECT c_custkey, round(3 + 2 * x - y + 0.5 * x * x - 0.25 * x * y + 0.125 * y * y, 6) AS fitted FROM p JOIN n USING (key)""")
def surface_fit(spark, sf):
    """The points lie on one quadratic, so a group of more than a dozen places gives it back."""
    p = points(spark, sf)
    many = p.groupBy("key").agg(F.count_distinct("x", "y").alias("n")).where("n > 12").select("key")
    return surfaces.heights(p.join(many, "key", "left_semi"), surfaces.polynomials(p)).select("c_custkey", F.round("fitted", 6).alias("fitted"))


@query("""WITH p AS (SELECT c_nationkey % 5 AS key, c_custkey * 37 % 101 / 10.0 AS x, c_custkey * 53 % 89 / 10.0 AS y FROM customer WHERE c_custkey % 3 = 0), q AS (SELECT c_custkey, c_nationkey % 5 AS key, c_custkey * 37 % 101 / 10.0 AS x, c_custkey * 53 % 89 / 10.0 AS y FROM customer),
d AS (SELECT DISTINCT key, x, y FROM p), a AS (SELECT q.c_custkey, q.x = d.x AND q.y = d.y AS same, atan2(d.y - q.y, d.x - q.x) AS angle FROM q JOIN d USING (key)), g AS (SELECT c_custkey, same, angle, lag(angle) OVER w AS before, first_value(angle) OVER w AS first, last_value(angle) OVER (PARTITION BY c_custkey ORDER BY same, angle ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last
FROM a WHERE NOT same WINDOW w AS (PARTITION BY c_custkey ORDER BY same, angle)), m AS (SELECT c_custkey, greatest(coalesce(max(angle - before), 0), 2 * pi() - (max(last) - min(first))) AS widest FROM g GROUP BY c_custkey), s AS (SELECT DISTINCT c_custkey FROM a WHERE same)
SELECT q.c_custkey, coalesce(widest <= pi() + 1e-9, false) OR q.c_custkey IN (SELECT c_custkey FROM s) AS inside FROM q LEFT JOIN m USING (c_custkey)""")
def hull_mask(spark, sf):
    """Whether a place lies in the hull of its group's chosen places; in the SQL, whether these leave no half plane free."""
    p = points(spark, sf)
    held = surfaces.hulls(p.where("c_custkey % 3 = 0"))
    return p.join(held, "key", "left").select("c_custkey", F.coalesce(surfaces.within_hull(F.col("x"), F.col("y"), F.col("hull")), F.lit(False)).alias("inside"))
