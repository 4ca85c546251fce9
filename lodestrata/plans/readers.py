"""Readers and sinks on files made of the tables: what is written in a source's form is read back as it was."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import builds, catalogs, packets, sinks
from ..sources.shared import fresh_path
from ..sources.tables import load
from .registry import query


def _lines(df: DataFrame, value: str, name: str) -> str:
    """The folder of text files with a line for each row."""
    path = fresh_path(df.sparkSession, name)
    df.selectExpr(f"{value} AS value").write.text(path)
    return path


_JSON = """CASE c_custkey % 10 WHEN 0 THEN 'bad line' WHEN 1 THEN '  ' ELSE to_json(named_struct('id', c_custkey, 'text', CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END)) END"""


@query("SELECT CASE WHEN c_custkey % 10 > 1 THEN c_custkey END AS id, CASE WHEN c_custkey % 10 > 1 THEN CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END END AS text, c_custkey % 10 = 0 AS is_error FROM customer WHERE c_custkey % 10 <> 1")
def read_jsonl(spark, sf):
    path = _lines(load(spark, sf, "customer"), _JSON, "jsonl")
    return catalogs.jsonl(spark, path, "id long, text string").select("r.id", "r.text", "is_error")


@query("SELECT count(*) FILTER (WHERE c_custkey % 10 <> 1) AS records, count(*) FILTER (WHERE c_custkey % 10 > 1 AND c_custkey % 3 <> 0) AS texts, count(*) FILTER (WHERE c_custkey % 10 > 1) AS ids FROM customer")
def profile_jsonl(spark, sf):
    path = _lines(load(spark, sf, "customer"), _JSON, "jsonl")
    return catalogs.profile_jsonl(spark, path, "text", "id").agg(F.sum("records").alias("records"), F.sum("text_records").alias("texts"), F.sum("id_records").alias("ids"))


@query("SELECT s_suppkey::VARCHAR AS key, s_name || ', \"x\"' AS name FROM supplier")
def read_headed_csv(spark, sf):
    path = fresh_path(spark, "csv")
    s = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.concat("s_name", F.lit(', "x"')).alias("name"))
    s.write.option("header", True).option("escape", '"').csv(path)
    return catalogs.headed_csv(spark, path, None).select("key", "name")


@query("SELECT DISTINCT o_orderkey::VARCHAR AS key, o_orderstatus AS state, CASE WHEN o_orderkey % 3 = 0 THEN 'q' || o_custkey END AS quality, o_custkey::VARCHAR AS cust FROM orders WHERE o_orderkey % 7 <> 2")
def read_drifting_csv(spark, sf):
    said = "CASE WHEN o_orderkey % 7 = 2 THEN concat(o_orderkey, ',short') WHEN o_orderkey % 3 = 0 THEN concat_ws(',', o_orderkey, o_orderstatus, concat('q', o_custkey), o_custkey) ELSE concat_ws(',', o_orderkey, o_orderstatus, o_custkey) END"
    o = load(spark, sf, "orders")
    return catalogs.drifting_csv(spark.read.text(_lines(o.unionByName(o.where("o_orderkey % 5 = 0")), said, "drift")), ["key", "state", "cust"], "quality", 2)


@query("""SELECT o_orderkey::VARCHAR AS event_id, '2024-01-' || lpad((o_orderkey % 28 + 1)::VARCHAR, 2, '0') AS day, round(45 + o_custkey % 60 / 60.0, 6) AS latitude, round(-(130 + o_orderkey % 60 / 60.0), 6) AS longitude, (o_custkey % 50)::INTEGER AS readings,
round(o_totalprice / 1e6, 4) AS depth, CASE WHEN o_orderkey % 6 <> 0 THEN round(o_custkey % 30 / 10.0, 4) END AS magnitude FROM orders WHERE o_orderkey % 11 <> 3""")
def read_hypocentres(spark, sf):
    said = """CASE WHEN o_orderkey % 11 = 3 THEN 'too short' ELSE concat_ws(' ', concat('202401', lpad(o_orderkey % 28 + 1, 2, '0')), '0930', '12.50', '45', o_custkey % 60, '130', o_orderkey % 60, round(o_totalprice / 1e6, 4),
    CASE WHEN o_orderkey % 6 = 0 THEN 'NaN' ELSE o_custkey % 30 / 10.0 END, o_custkey % 50, 100, 1.5, 0.1, 0.2, 0.3, o_orderkey, 1e10, 2e10) END"""
    found = catalogs.hypocentre_lines(spark.read.text(_lines(load(spark, sf, "orders"), said, "hypo")))
    return found.select("event_id", F.date_format("event_date", "yyyy-MM-dd").alias("day"), "latitude", "longitude", F.col("weighted_readings").alias("readings"), F.round("depth_km", 4).alias("depth"), F.round("magnitude_mw", 4).alias("magnitude"))


@query("SELECT p_partkey::VARCHAR AS event_id, p_size::DOUBLE AS strike, (p_partkey % 9)::INTEGER AS analogs, (p_partkey % 3 - 1)::INTEGER AS cc1 FROM part WHERE p_partkey % 5 <> 1")
def read_focals(spark, sf):
    said = "CASE WHEN p_partkey % 5 = 1 THEN '# note' ELSE concat_ws(' ', p_partkey, '2015-04-24T06:00:00', 45.9, -130.0, 1.1, 2.0, p_size, 45, -90, 'N', 'A', p_partkey % 9, 0.4, 2, 1, -1, p_partkey % 3 - 1, 1, 1, 1, -1) END"
    p = load(spark, sf, "part")
    found = catalogs.focal_lines(spark.read.text(_lines(p.unionByName(p.where("p_size > 40")), said, "focal")))
    return found.select("event_id", F.col("strike_deg").alias("strike"), F.col("analog_count").alias("analogs"), F.col("station_polarities")["CC1"].alias("cc1"))


@query("SELECT o_orderkey::VARCHAR AS header, count(l_orderkey) AS picks, coalesce(string_agg(l_linenumber || ':' || l_suppkey, ';' ORDER BY l_linenumber, l_suppkey), '') AS said FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def read_nested_picks(spark, sf):
    heads = load(spark, sf, "orders").selectExpr("o_orderkey AS k", "0 AS a", "0L AS b", "concat('# ', o_orderkey) AS value")
    picks = load(spark, sf, "lineitem").join(heads.select("k"), F.col("l_orderkey") == F.col("k"), "left_semi").selectExpr("l_orderkey AS k", "l_linenumber AS a", "l_suppkey AS b", "concat(l_linenumber, ' ', l_suppkey) AS value")
    lines = heads.unionByName(picks).select(F.struct("k", "a", "b", F.xxhash64("value", F.monotonically_increasing_id()).alias("row")).alias("n"), "value")
    found = catalogs.nested_picks(lines, "n")
    return found.select("header", F.size("picks").cast("long").alias("picks"), F.array_join(F.transform("picks", lambda p: F.array_join(p, ":")), ";").alias("said"))


@query("""WITH e AS (SELECT event_type, floor(epoch_us(ts) / 3.6e9)::BIGINT AS t, min(round(value, 2)) AS v FROM events GROUP BY ALL) SELECT t::DOUBLE AS time, arg_max(v, event_type) AS value FROM e GROUP BY t""")
def read_array_blocks(spark, sf):
    e = load(spark, sf, "events").groupBy("event_type", F.expr("floor(unix_micros(CAST(ts AS TIMESTAMP)) / 3.6e9)").alias("t"), F.expr("date(ts)").alias("day")).agg(F.min(F.round("value", 2)).alias("v"))
    rows = e.groupBy("event_type", "day").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("r"))  # a day's hours
    said = F.concat(F.lit("Dataset\ntime["), F.size("r"), F.lit("]\n"), F.array_join(F.transform("r", lambda x: x["t"].cast("string")), ", "), F.lit(", 0\ndepth["), F.size("r"), F.lit("]\n"), F.array_join(F.transform("r", lambda x: x["v"].cast("string")), ", "), F.lit(", -9999999\n"))
    return catalogs.array_blocks(rows.select(F.col("event_type").alias("file"), said.alias("text")), "depth")


@query("SELECT name, unit, \"row\", value FROM (SELECT 'key' AS name, 'id' AS unit, s_suppkey + 2 AS \"row\", s_suppkey::VARCHAR AS value FROM supplier UNION ALL SELECT 'nation', 'code', s_suppkey + 2, s_nationkey::VARCHAR FROM supplier WHERE s_nationkey % 4 > 1)")
def read_units_csv(spark, sf):
    s = load(spark, sf, "supplier").selectExpr("s_suppkey + 2 AS n", "concat_ws(',', s_suppkey, CASE s_nationkey % 4 WHEN 0 THEN 'NaN' WHEN 1 THEN '' ELSE CAST(s_nationkey AS STRING) END) AS value")
    head = spark.createDataFrame([(0, "key,nation"), (1, "id,code")], "n long, value string")
    return catalogs.units_csv(head.unionByName(s), "n").select("name", "unit", "row", "value")


@query("SELECT page_id, unnest([page_id || '.nc', 'sub' || page_id || '/']) AS name, unnest([false, true]) AS is_folder FROM pages")
def read_listing(spark, sf):
    made = F.concat(F.lit('<a href="/up">u</a><a href="../">p</a><A class="x" HREF="'), "page_id", F.lit('.nc">a</A><a href="sub'), "page_id", F.lit('/">b</a><a href="http://x.org/">c</a>'))
    return catalogs.directory_listing(load(spark, sf, "pages").select("page_id", made.alias("html")), "page_id", "html")


@query("SELECT p_brand AS station, p_partkey::VARCHAR AS channel, (p_size * 10)::DOUBLE AS rate, round(45 + p_partkey % 100 / 100.0, 4) AS latitude, CASE WHEN p_size > 25 THEN '2014-08-01T00:00:00' END AS started FROM part")
def read_station_epochs(spark, sf):
    said = """concat('<Station code="', p_brand, '"><Channel code="', p_partkey, '" locationCode=""', CASE WHEN p_size > 25 THEN ' startDate="2014-08-01T00:00:00"' ELSE '' END, '><Latitude>', 45 + p_partkey % 100 / 100.0,
    '</Latitude><SampleRate>', p_size * 10, '</SampleRate></Channel></Station>')"""
    files = load(spark, sf, "part").groupBy(F.floor(F.col("p_partkey") / 50).alias("file")).agg(F.array_join(F.collect_list(F.expr(said)), "").alias("stations"))  # fifty stations a file
    path = fresh_path(spark, "stations")
    files.select("file", F.concat(F.lit('<FDSNStationXML><Network code="OO">'), "stations", F.lit("</Network></FDSNStationXML>")).alias("value")).write.partitionBy("file").text(path)
    found = catalogs.station_epochs(spark, path)
    return found.select("station", "channel", "rate", F.round("latitude", 4).alias("latitude"), F.col("start").alias("started"))


@query("SELECT user_id::VARCHAR AS path, round(min(epoch_us(ts) // 1000000), 0)::DOUBLE AS started, round(count(*) / 20.0, 4) AS seconds FROM events GROUP BY user_id")
def read_packet_spans(spark, sf):
    e = load(spark, sf, "events").withColumn("s", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000))
    series = e.groupBy("user_id").agg(F.min("s").alias("start"), F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x % 100).alias("samples"))
    files = packets.write_records(series.withColumn("series", F.col("user_id").cast("string")), 20).withColumnRenamed("series", "path")
    return catalogs.packet_spans(files).groupBy("path").agg(F.round(F.min("start"), 0).alias("started"), F.round(F.max("end") - F.min("start"), 4).alias("seconds"))


@query("SELECT '{\"a\":' || s_suppkey || CASE WHEN s_nationkey > 12 THEN '' ELSE ',\"b\":\"' || s_name || '\"' END || '}' AS value FROM supplier")
def write_canonical_json(spark, sf):
    return sinks.canonical_json(load(spark, sf, "supplier").select(F.when(F.col("s_nationkey") <= 12, F.col("s_name")).alias("b"), F.col("s_suppkey").alias("a")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'old' ELSE 'new' END AS origin FROM customer")
def append_without_repeats(spark, sf):
    path = fresh_path(spark, "appended")
    c = load(spark, sf, "customer").select("c_custkey")
    c.where("c_custkey % 2 = 0").withColumn("origin", F.lit("old")).write.parquet(path)
    for _ in range(2):  # a batch given twice changes nothing
        sinks.append_new(c.withColumn("origin", F.lit("new")), path, ["c_custkey"])
    return spark.read.parquet(path)


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 1")
def resumed_build(spark, sf):
    """What a build that stopped after one batch has still to do."""
    path = fresh_path(spark, "build")
    rows = load(spark, sf, "documents").select("doc_id", "text")
    builds.add_batch(builds.resume(rows, path, {"model": "m1"}, "doc_id", "text").where("doc_id % 3 = 1"), path)
    return builds.resume(rows, path, {"model": "m1"}, "doc_id", "text").select("doc_id")
