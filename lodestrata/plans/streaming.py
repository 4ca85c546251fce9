"""Batch twins of the streaming operators, over the whole events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import upserts
from ..sources.shared import fresh_path
from ..sources.tables import epoch_seconds, load
from ..streaming import events
from .registry import query


@query("SELECT CAST(floor(epoch_us(ts) / 6e8) AS BIGINT) AS bin, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def stream_window_counts(spark, sf):
    w = events.window_counts(load(spark, sf, "events"))
    return w.select(F.floor(epoch_seconds("start") / 600).alias("bin"), "event_type", "n", F.round("mean", 6).alias("mean"))


@query("""WITH b AS (SELECT event_type, ts, unnest([0, 1, 2, 3]) AS k FROM events) SELECT CAST(floor(epoch_us(ts) / 3.6e9) AS BIGINT) - k AS bin, event_type, count(*) AS n FROM b GROUP BY ALL""")
def stream_sliding_counts(spark, sf):
    w = events.window_counts(load(spark, sf, "events"), "4 hours", "1 hour")
    return w.select(F.floor(epoch_seconds("start") / 3600).alias("bin"), "event_type", "n")


@query("""WITH d AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events), r AS (SELECT *, sum(CASE WHEN d IS NULL OR d >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM d)
SELECT user_id, count(*) AS n, round(epoch_us(min(ts)) / 1e6, 3) AS started FROM r GROUP BY user_id, s""")
def stream_sessions(spark, sf):
    return events.sessions(load(spark, sf, "events")).select("user_id", "n", F.round(epoch_seconds("start"), 3).alias("started"))


@query("""WITH m AS (SELECT max(epoch_us(ts)) - 3600000000 AS frontier FROM events), w AS (SELECT CAST(floor(epoch_us(ts) / 6e8) AS BIGINT) AS bin, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT bin, event_type, n, CASE WHEN n >= 2 THEN 'good' ELSE 'thin' END AS grade FROM w, m WHERE (bin + 1) * 600000000 <= frontier""")
def stream_closed_windows(spark, sf):
    w = events.graded(events.closed_windows_of(load(spark, sf, "events")), 2)
    return w.select(F.floor(epoch_seconds("start") / 600).alias("bin"), "event_type", "n", "grade")


@query("""WITH c AS (SELECT user_id, event_id, CASE WHEN event_type <> 'signup' THEN value END AS value, event_type = 'signup' AS deleted FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM c)
SELECT user_id, event_id, value FROM r WHERE k = 1 AND NOT deleted""")
def table_after_changes(spark, sf):
    """The table that three batches of changes leave, one of them given twice."""
    path = fresh_path(spark, "kept")
    gone = F.col("event_type") == "signup"
    changes = load(spark, sf, "events").select("user_id", "event_id", F.when(~gone, F.col("value")).alias("value"), gone.alias("deleted"))
    for batch, part in ((0, 1), (1, 0), (1, 2), (2, 2)):
        upserts.apply(changes.where(F.col("event_id") % 3 == part), batch, path, ["user_id"], "event_id")
    return upserts.live(upserts.read(spark, path))
