"""Readers and sinks on small inline inputs."""

import struct

from pyspark.sql import functions as F

from lodestrata.sources import catalogs, sinks


def test_hypocentres_roll_over_and_drop_nan(spark):
    lines = [
        "yyyymmdd HHMMSSS.SS Lat(D M) Lon(D M) Depth MW NWR GAP DMIN RMS ERH ERZ ID PMom SMom",
        "20260918 2359 60.00 45 60.00 129 60.00 1.25 0.13 12 246 0.9 0.04 1.1 0.9 571855 2.1e+18 NaN",
        "20260918 1200 00.00 45 56.00 130 1.00 0.50 -0.20 8 180 1.2 0.03 0.5 0.6 571856 1e+17 2e+17",
        "20260918 1260 00.00 45 56.00 130 1.00 0.50 -0.20 8 180 1.2 0.03 0.5 0.6 1 1e+17 2e+17",
        "20260918 1200 00.00 45 x 130 1.00 0.50 -0.20 8 180 1.2 0.03 0.5 0.6 2 1e+17 2e+17",
        "20260918 1200 00.00 45 56.00 130 1.00 0.50 -0.20 8.5 180 1.2 0.03 0.5 0.6 3 1e+17 2e+17",
        "bad line",
    ]
    df = spark.createDataFrame(list(enumerate(lines, 1)), "source_line long, value string")
    got = catalogs.hypocentre_lines(df).orderBy("event_id").collect()
    assert [(r.event_id, r.source_line, r.weighted_readings) for r in got] == [("571855", 2, 12), ("571856", 3, 8)]
    assert got[0].origin_time.isoformat() == "2026-09-19T00:00:00" and got[0].event_date.isoformat() == "2026-09-18"
    assert (got[0].latitude, got[0].longitude, got[0].s_moment, got[0].p_moment) == (46.0, -130.0, None, 2.1e18)
    assert got[1].magnitude_mw == -0.2 and got[0].record_key != got[1].record_key and len(got[0].record_key) == 24


def test_focal_lines_keep_whole_rows_once(spark):
    row = "7 2015-04-24T06:00:00 45.95 -130.0 1.1 NaN 90 45 -90 N A 6 .4 2 1 -1 0 1 1 1 -1"
    lines = ["# comment", row, row, row + " 9", row.replace(" A 6 ", " A x ")]
    (r,) = catalogs.focal_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert (r.event_id, r.origin_time_utc, r.magnitude_mw, r.analog_count, r.fault_type) == ("7", "2015-04-24T06:00:00Z", None, 6, "N")
    assert r.station_polarities == {"AS1": 1, "AS2": -1, "CC1": 0, "EC1": 1, "EC2": 1, "EC3": 1, "ID1": -1}


def test_headed_csv_and_station_epochs(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbfname,value\n\"x, y\",1\nz,\n")
    got = sorted((r.name, r.value) for r in catalogs.headed_csv(spark, str(tmp_path / "a.csv")).collect())
    assert got == [("x, y", "1"), ("z", None)]
    (tmp_path / "s.xml").write_text(
        '<FDSNStationXML><Network code="OO"><Station code="AXCC1"><Channel code="HHZ" locationCode="" startDate="2014-08-01T00:00:00">'
        "<Latitude>45.95</Latitude><Longitude>-130.0</Longitude><Elevation>-1528</Elevation><Depth>0</Depth><Azimuth>0</Azimuth><Dip>-90</Dip><SampleRate>200</SampleRate>"
        "</Channel></Station></Network></FDSNStationXML>"
    )
    (r,) = catalogs.station_epochs(spark, str(tmp_path / "s.xml")).collect()
    assert (r.network, r.station, r.channel, r.dip, r.rate, r.end) == ("OO", "AXCC1", "HHZ", -90.0, 200.0, None)


def test_nested_picks(spark):
    df = spark.createDataFrame(list(enumerate(["# 1 a", "ST1 0.5", "ST2 0.7", "# 2 b"])), "n long, value string")
    got = sorted(tuple(r) for r in catalogs.nested_picks(df, "n").select("header", "picks").collect())
    assert got == [("1 a", [["ST1", "0.5"], ["ST2", "0.7"]]), ("2 b", [])]


def test_drifting_csv(spark):
    df = spark.createDataFrame([("1,2,3",), ("1,2,3",), ("1,2,A,3",), ("1,2",)], "value string")
    got = {tuple(r) for r in catalogs.drifting_csv(df, ["a", "b", "c"], "quality", 2).collect()}
    assert got == {("1", "2", None, "3"), ("1", "2", "A", "3")}


def test_array_blocks_last_file_wins(spark):
    a = "time[3]\n1, 2, 3\ndepth[3]\n-1509.8, -9999999, -1512.2"
    b = "time[1]\n3\ndepth[1]\n-1513.0"
    df = spark.createDataFrame([("a", a), ("b", b)], "file string, text string")
    assert {tuple(r) for r in catalogs.array_blocks(df, "depth").collect()} == {(1.0, -1509.8), (3.0, -1513.0)}


def test_units_csv_and_listing(spark):
    df = spark.createDataFrame(list(enumerate(["time,temp", "UTC,degC", "t0,1.5", "t1,NaN"])), "n long, value string")
    got = {tuple(r) for r in catalogs.units_csv(df, "n").collect()}
    assert got == {("time", "UTC", 2, "t0"), ("temp", "degC", 2, "1.5"), ("time", "UTC", 3, "t1")}
    pages = spark.createDataFrame([(1, '<a href="x/">x</a><a href="y.nc">y</a><a href="/up">u</a>')], "id long, html string")
    assert {tuple(r) for r in catalogs.directory_listing(pages, "id", "html").collect()} == {(1, "x/", True), (1, "y.nc", False)}


def test_packet_spans(spark):
    def record(n, factor, multiplier, length, power, end=">"):
        head = b"000001D STA  00HHZNW" + struct.pack(end + "HHBBBBHHhh", 2024, 2, 1, 0, 0, 0, 0, n, factor, multiplier) + b"\0" * 4 + struct.pack(end + "I", 0) + struct.pack(end + "HH", 64, 48)
        return (head[:48] + struct.pack(end + "HHBBBB", 1000, 0, 10, 1, power, 0)).ljust(length, b"\0")

    data = record(800, 8, 1, 512, 9) + record(400, 8, 1, 4096, 12) + record(0, 8, 1, 512, 9) + record(300, -10, 1, 512, 9, "<") + record(600, 20, -2, 512, 9) + record(5, 0, 1, 512, 9)
    df = spark.createDataFrame([("f", bytearray(data)), ("short", bytearray(b"x"))], "path string, content binary")
    got = catalogs.packet_spans(df).collect()
    assert sorted((round(r.end - r.start, 6), r.rate) for r in got) == [(50.0, 8.0), (60.0, 10.0), (100.0, 8.0), (3000.0, 0.1)]
    assert {(r.station, r.channel, r.start) for r in got} == {("STA", "HHZ", 1704157200.0)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None)], "z long, a string")
    assert {r.value for r in sinks.canonical_json(df).collect()} == {'{"a":"b","z":2}', '{"z":1}'}
    path = str(tmp_path / "table")
    sinks.publish(df, path, lambda d: None)
    try:
        sinks.publish(df, path, lambda d: "no")
        raise AssertionError
    except ValueError:
        pass
    sinks.append_new(spark.createDataFrame([(1, "x"), (3, "y"), (3, "y")], "z long, a string"), path, ["z"])
    assert sorted(r.z for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    assert spark.range(1).select(sinks.packed(F.lit(1.2345), 1000).alias("p")).first().p in (1234, 1235)


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"1","text":"x"}\n\n{"id":"2"}\n[1]\n')
    got = catalogs.jsonl(spark, str(tmp_path), "id string, text string")
    assert got.count() == 3 and got.where("is_error").count() == 1
    p = catalogs.profile_jsonl(spark, str(tmp_path), "text", "id").first()
    assert (p.records, p.text_records, p.id_records) == (3, 1, 2)
