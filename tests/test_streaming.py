"""Streaming operators against their batch twins."""

from pyspark.sql import functions as F

from lodestrata.sources.tables import load
from lodestrata.streaming import events


def _folder(spark, sf_dir, tmp_path):
    path = str(tmp_path / "events")
    load(spark, sf_dir, "events").orderBy("ts").coalesce(2).write.parquet(path)
    return path


def test_window_counts_equal_batch(spark, sf_dir, tmp_path):
    stream = events.window_counts(events.read_events(spark, _folder(spark, sf_dir, tmp_path)))
    got = events.run_to_table(stream, "w1", str(tmp_path / "cp"), "complete")
    want = events.window_counts(load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    key = lambda df: sorted((r.start, r.event_type, r.n) for r in df.collect())
    assert key(got) == key(want)


def test_state_since_ends_like_batch(spark, sf_dir, tmp_path):
    stream = events.state_since(events.read_events(spark, _folder(spark, sf_dir, tmp_path)), 50.0)
    got = events.run_to_table(stream, "s1", str(tmp_path / "cp"), "update")
    last = {r.user_id: r.state for r in got.orderBy("seen_us").collect()}
    want = load(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by(F.when(F.col("value") > 50, "high").otherwise("low"), "ts").alias("state"))
    assert last == {r.user_id: r.state for r in want.collect()}


def test_repeats_are_dropped(spark, sf_dir, tmp_path):
    path = _folder(spark, sf_dir, tmp_path)
    load(spark, sf_dir, "events").limit(100).write.mode("append").parquet(path)
    got = events.run_to_table(events.without_repeats(events.read_events(spark, path, "60 days")), "d1", str(tmp_path / "cp"))
    assert got.count() == load(spark, sf_dir, "events").count()


def test_windows_close_beyond_the_frontier_only(spark, sf_dir, tmp_path):
    path = _folder(spark, sf_dir, tmp_path)
    stream = events.closed_windows(events.read_events(spark, path))
    got = events.run_to_table(stream, "c1", str(tmp_path / "cp"))
    want = events.closed_windows_of(load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    key = lambda df: sorted((r.start, r.event_type, r.n) for r in df.collect())
    assert key(got) == key(want) and got.count() > 0
    late = load(spark, sf_dir, "events").orderBy("ts").limit(5).withColumn("ts", F.col("ts") - F.expr("INTERVAL 9 HOURS"))
    late.coalesce(1).write.mode("append").parquet(path)
    again = events.closed_windows(events.read_events(spark, path))
    again.writeStream.format("parquet").option("path", str(tmp_path / "late")).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "late")).count() >= got.count()


def test_changes_apply_once_across_restarts(spark, tmp_path):
    from lodestrata.sources import upserts

    source, table, cp = str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "cp")
    schema = "id long, version long, name string, deleted boolean"
    write = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    read = lambda: sorted(tuple(r) for r in upserts.live(upserts.read(spark, table)).collect())
    run = lambda: events.keep_current(spark.readStream.schema(schema).parquet(source), table, ["id"], "version", cp)
    write((1, 1, "a", False), (2, 1, "b", False), (1, 2, "A", False))
    run()
    assert read() == [(1, 2, "A"), (2, 1, "b")]
    held = upserts.pointer(spark, table)
    run()  # nothing new
    assert upserts.pointer(spark, table) == held
    assert not upserts.apply(spark.createDataFrame([(9, 9, "x", False)], schema), held["batch"], table, ["id"], "version")
    write((2, 3, None, True), (3, 1, "c", False))
    run()
    write((2, 2, "late", False))
    run()
    assert read() == [(1, 2, "A"), (3, 1, "c")]
    listing = spark.createDataFrame([(3,)], "id long")
    gone = upserts.missing(upserts.read(spark, table), listing, ["id"], "version", 10)
    assert upserts.apply(gone, upserts.pointer(spark, table)["batch"] + 1, table, ["id"], "version")
    assert read() == [(3, 1, "c")]


def test_a_version_with_a_complaint_is_never_named(spark, tmp_path):
    import pytest

    from lodestrata.sources import upserts

    path = str(tmp_path / "t")
    upserts.publish(spark.range(3), path)
    with pytest.raises(ValueError):
        upserts.publish(spark.range(5), path, lambda df: "five" if df.count() == 5 else None)
    assert upserts.read(spark, path).count() == 3
    for n in (4, 6, 7):
        upserts.publish(spark.range(n), path)
    assert upserts.read(spark, path).count() == 7 and len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("version")]) <= 2
