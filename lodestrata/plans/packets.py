"""Events' values as seismic records and back: every sample survives the packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import packets
from ..sources.tables import epoch_seconds, load
from .registry import query


@query("""WITH s AS (SELECT user_id, floor(epoch_us(ts) / 8.64e10)::BIGINT AS day, event_id, floor(value * 100)::BIGINT AS v FROM events)
SELECT user_id, day, count(*) AS n, sum(v)::DOUBLE AS total, arg_min(v, event_id)::DOUBLE AS first, arg_max(v, event_id)::DOUBLE AS last, sum(v * rank)::DOUBLE AS weighted FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY event_id) AS rank FROM s) GROUP BY user_id, day""")
def packet_samples(spark, sf):
    """A user's values of a day, in order, as one series."""
    day = F.floor(epoch_seconds("ts") / 86400).alias("day")
    own = load(spark, sf, "events").select("user_id", day, F.struct("event_id", F.floor(F.col("value") * 100).alias("v")).alias("row"))
    rows = own.groupBy("user_id", "day").agg(F.array_sort(F.collect_list("row")).alias("rows"))  # one user's day
    series = rows.select(F.concat_ws("/", "user_id", "day").alias("series"), (F.col("day") * 86400).alias("start"), F.transform("rows", lambda r: r["v"]).alias("samples"))
    found = packets.decoded_records(packets.write_records(series, 20).withColumnRenamed("series", "path"))
    # A record's samples go on where the one before ended: its start tells how many came before.
    before = F.round((F.col("start") - F.substring_index("path", "/", -1).cast("long") * 86400) * F.col("rate")).cast("long")
    samples = found.select("path", F.posexplode("samples").alias("at", "v"), before.alias("before"))
    samples = samples.select("path", "v", (F.col("before") + F.col("at") + 1).alias("rank"))
    out = samples.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.min_by("v", "rank").alias("first"), F.max_by("v", "rank").alias("last"), F.sum(F.col("v") * F.col("rank")).alias("weighted"))
    key = F.split("path", "/")
    return out.select(key[0].cast("long").alias("user_id"), key[1].cast("long").alias("day"), "n", "total", "first", "last", "weighted")
