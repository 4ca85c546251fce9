"""Structured Streaming forms of the coverage, session and carry-forward operators, with batch twins to check them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shipping import ship

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def read_events(spark: SparkSession, path: str, lateness: str = "1 hour") -> DataFrame:
    """A stream over a folder of event files. Watermarks need a zoned time stamp, so ``ts`` is cast."""
    return spark.readStream.schema(EVENTS).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def window_counts(events: DataFrame, width: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and means per type over tumbling (or sliding) windows; works on streams and tables."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select("w.start", "w.end", "event_type", "n", "mean")


def closed_windows(events: DataFrame, width: str = "10 minutes") -> DataFrame:
    """Windows that the frontier has passed: on a stream, in append mode, each comes once, when the watermark reaches its
    end; what has not been reached is no gap yet. Rows behind the watermark change nothing."""
    return window_counts(events, width)


def closed_windows_of(table: DataFrame, lateness: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """The batch twin of ``closed_windows``: the windows that end at or before the newest row less ``lateness``."""
    frontier = table.agg((F.max("ts") - F.expr(f"INTERVAL {lateness}")).alias("frontier"))
    return window_counts(table, width).crossJoin(F.broadcast(frontier)).where("end <= frontier").drop("frontier")


def graded(windows: DataFrame, needed: int) -> DataFrame:
    """Each closed window's grade: 'good' from ``needed`` rows on, else 'thin'."""
    return windows.withColumn("grade", F.when(F.col("n") >= needed, "good").otherwise("thin"))


def keep_current(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str):
    """Applies a stream of changes to the table at ``path``, each batch once however often the stream is restarted."""
    from ..sources import upserts

    def one(batch: DataFrame, batch_id: int) -> None:
        upserts.apply(batch, batch_id, path, keys, order)

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of users: a new one after ``gap`` without events."""
    return events.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", "s.start", "s.end", "n")


def without_repeats(events: DataFrame, key: str = "event_id") -> DataFrame:
    """First arrival of each key within the watermark."""
    return events.dropDuplicatesWithinWatermark([key])


def state_since(events: DataFrame, threshold: float) -> DataFrame:
    """Per user: the state (high or low value) after each micro-batch and since when it holds."""
    ship(events.sparkSession)

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        current, since, seen = state.get if state.exists else (None, None, None)
        rows = pd.concat(list(batches)).sort_values("ts")
        for ts, value in zip(rows["ts"], rows["value"], strict=True):
            if seen is not None and ts.value // 1000 < seen:
                continue  # later arrivals than the state's own time say nothing new
            now = "high" if value > threshold else "low"
            seen = ts.value // 1000
            if now != current:
                current, since = now, seen
        state.update((current, since, seen))
        yield pd.DataFrame({"user_id": [key[0]], "state": [current], "since_us": [since], "seen_us": [seen]})

    from pyspark.sql.streaming.state import GroupStateTimeout

    return events.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, state string, since_us long, seen_us long", "state string, since_us long, seen_us long", "update", GroupStateTimeout.NoTimeout
    )


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there now and return the result, for tests and backfills."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
