"""Readers of line-based catalogs: whitespace records, drifting CSV, nested records, array blocks, directory pages, JSONL, packets.

All but the packet reader are column expressions over ``spark.read.text`` or a
table of texts; a bad line becomes a null or a dropped row, never a failed job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import running
from .shipping import ship


#: The columns of the whitespace catalog from the depth on, by their place among the tokens.
HYPOCENTRE_NUMBERS = {
    "depth_km": 7,
    "magnitude_mw": 8,
    "azimuthal_gap_deg": 10,
    "nearest_station_km": 11,
    "rms_seconds": 12,
    "horizontal_error_km": 13,
    "vertical_error_km": 14,
    "p_moment": 16,
    "s_moment": 17,
}
EVENT_ID, WEIGHTED_READINGS = 15, 9


def hypocentre_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Whitespace catalog: at least 18 tokens, an 8-digit date, hhmm, seconds up to 60.00, degrees and minutes.

    Seconds of 60 roll over to the next minute (and day), the catalog day stays.
    West longitudes are negative. A row goes if its time, its position or its count of
    readings cannot be read; other values that are not finite become null. Times are in UTC
    if the session's zone is; columns of ``lines`` other than the text (file, line number) stay.
    """
    token = lambda i: F.get("_t", F.lit(i))
    kept = [c for c in lines.columns if c != line]
    rows = lines.select(*kept, F.col(line).alias("_line"), F.split(F.trim(F.col(line)), r"\s+").alias("_t")).where(F.size("_t") >= 18)
    start = F.when(token(0).rlike("^[0-9]{8}$") & token(1).rlike("^[0-9]{1,4}$"), F.try_to_timestamp(F.concat(token(0), F.lpad(token(1), 4, "0")), F.lit("yyyyMMddHHmm")))
    micros = F.round(_number(token(2)) * 1e6).cast("long")
    found = rows.select(
        *kept,
        F.substring(F.sha2("_line", 256), 1, 24).alias("record_key"),
        token(EVENT_ID).alias("event_id"),
        F.timestamp_micros(F.unix_micros(start) + micros).alias("origin_time"),
        F.to_date(start).alias("event_date"),
        F.round(_number(token(3)) + _number(token(4)) / 60, 6).alias("latitude"),
        F.round(-(_number(token(5)) + _number(token(6)) / 60), 6).alias("longitude"),
        token(WEIGHTED_READINGS).try_cast("int").alias("weighted_readings"),
        *[_number(token(i)).alias(name) for name, i in HYPOCENTRE_NUMBERS.items()],
    )
    return found.dropna(subset=["origin_time", "latitude", "longitude", "weighted_readings"])


def headed_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header row, a byte-order mark and doubled quotes allowed, with the file each row came from; values are text unless a schema is given."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE")
    rows = (reader.schema(schema) if schema else reader).csv(path)
    clean = [F.col(f"`{c}`").alias(c.lstrip("﻿").strip()) for c in rows.columns]
    return rows.select(*clean, F.col("_metadata.file_path").alias("file"))


#: The stations of the fixed 21-column focal file, in the order of their polarities.
FOCAL_STATIONS = ("AS1", "AS2", "CC1", "EC1", "EC2", "EC3", "ID1")
FOCAL_NUMBERS = {"latitude": 2, "longitude": 3, "depth_km": 4, "magnitude_mw": 5, "strike_deg": 6, "dip_deg": 7, "rake_deg": 8, "polarity_distance": 12, "location_distance_km": 13}


def focal_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Focal mechanisms of exactly 21 columns; comments, other lengths and repeats go, and so does a row with a bad count."""
    t = F.split(F.trim(F.col(line)), r"\s+")
    rows = lines.where(~F.col(line).startswith("#")).select(t.alias("t")).where(F.size("t") == 21).distinct()
    polarity = F.map_from_arrays(F.array(*[F.lit(s) for s in FOCAL_STATIONS]), F.transform(F.slice("t", 15, len(FOCAL_STATIONS)), lambda x: x.try_cast("int")))
    found = rows.select(
        F.get("t", 0).alias("event_id"),
        F.concat(F.get("t", 1), F.lit("Z")).alias("origin_time_utc"),
        *[_number(F.get("t", i)).alias(name) for name, i in FOCAL_NUMBERS.items()],
        F.get("t", 9).alias("fault_type"),
        F.get("t", 10).alias("quality"),
        F.get("t", 11).try_cast("int").alias("analog_count"),
        polarity.alias("station_polarities"),
    )
    return found.where(F.col("analog_count").isNotNull() & F.forall(F.map_values("station_polarities"), lambda x: x.isNotNull()))


def station_epochs(spark: SparkSession, path: str) -> DataFrame:
    """Channel epochs of StationXML files, by Spark's XML reader: network, station, channel, place, span, rate, azimuth, dip."""
    schema = """_code string, Station array<struct<_code: string, Channel: array<struct<_code: string, _locationCode: string, _startDate: string, _endDate: string,
        Latitude: double, Longitude: double, Elevation: double, Depth: double, Azimuth: double, Dip: double, SampleRate: double>>>>"""
    networks = spark.read.option("rowTag", "Network").schema(schema).format("xml").load(path)
    stations = networks.select(F.col("_code").alias("network"), F.explode("Station").alias("s"))
    channels = stations.select("network", F.col("s._code").alias("station"), F.explode("s.Channel").alias("c"))
    names = {"channel": "_code", "location": "_locationCode", "start": "_startDate", "end": "_endDate", "latitude": "Latitude", "longitude": "Longitude", "elevation": "Elevation", "depth": "Depth", "azimuth": "Azimuth", "dip": "Dip", "rate": "SampleRate"}
    return channels.select("network", "station", *[F.col(f"c.{raw}").alias(name) for name, raw in names.items()])


def _number(c: Column) -> Column:
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def nested_picks(lines: DataFrame, order: str, line: str = "value") -> DataFrame:
    """A '#' row opens an event, the rows after it are its picks: (header, picks array)."""
    files = ["file"] if "file" in lines.columns else []
    keys = [*files, "event"]
    heads = lines.withColumn("head", F.col(line).startswith("#")).withColumn("_opens", F.col("head").cast("int"))
    # A running count over blocks of rows: one long file is not one task's.
    numbered = running(heads, files, [order], "_opens").withColumnRenamed("running_sum", "event").where("event > 0")
    return numbered.groupBy(*keys).agg(
        F.max(F.when(F.col("head"), F.trim(F.substring(F.col(line), F.lit(2), F.length(line))))).alias("header"),
        F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct(order, F.split(F.trim(F.col(line)), r"\s+").alias("pick"))))), lambda x: x.pick).alias("picks"),
    )


def drifting_csv(lines: DataFrame, header: list[str], extra: str, at: int, line: str = "value") -> DataFrame:
    """Rows of ``header`` with or without one more column ``extra`` at position ``at``; other lengths and repeats go."""
    p = F.split(F.col(line), ",", -1)
    n = len(header)
    rows = lines.select(p.alias("p")).where(F.size("p").isin(n, n + 1)).distinct()
    wide = F.size("p") == n + 1
    columns = []
    for i, name in enumerate(header):
        columns.append(F.get("p", F.lit(i) if i < at else F.when(wide, i + 1).otherwise(i)).alias(name))
    columns.insert(at, F.when(wide, F.get("p", F.lit(at))).alias(extra))
    return rows.select(*columns)


def array_blocks(texts: DataFrame, value_name: str, file: str = "file", text: str = "text", fill: float = -9e5) -> DataFrame:
    """ASCII array blocks ``name[n]`` + comma list: (time, value), fill values dropped, the last file wins."""
    block = lambda name: F.split(F.regexp_extract(F.col(text), rf"(?m)^{name}\[[0-9]+\]\s*\n([^\n]*)", 1), r",\s*")
    pairs = texts.select(file, F.explode(F.arrays_zip(block("time").alias("t"), block(value_name).alias("v"))).alias("x"))
    rows = pairs.select(file, F.col("x.t").try_cast("double").alias("time"), F.col("x.v").try_cast("double").alias("value")).where(F.col("value") > fill)
    return rows.groupBy("time").agg(F.max_by("value", file).alias("value"))


def units_csv(lines: DataFrame, order: str, line: str = "value") -> DataFrame:
    """CSV whose first row names the columns and second gives the units: (name, unit, row, value), NaN and blanks dropped."""
    p = lines.select(order, F.split(F.col(line), ",", -1).alias("p"))
    names = p.where(F.col(order) == 0).select(F.posexplode("p").alias("i", "name"))
    units = p.where(F.col(order) == 1).select(F.posexplode("p").alias("i", "unit"))
    cells = p.where(F.col(order) > 1).select(F.col(order).alias("row"), F.posexplode("p").alias("i", "cell"))
    head = F.broadcast(names.join(units, "i"))  # one row per column
    return cells.where("cell <> '' AND cell <> 'NaN'").join(head, "i").select("name", "unit", "row", F.col("cell").alias("value"))


def directory_listing(pages: DataFrame, id_: str, html: str) -> DataFrame:
    """Anchors of a listing page that stay below it: (id, name, is_folder)."""
    link = F.explode(F.regexp_extract_all(F.col(html), F.lit('(?i)<a[^>]+href="([^"?#]+)"'), 1)).alias("name")
    return pages.select(id_, link).where("name NOT LIKE '/%' AND name NOT LIKE '..%' AND name NOT LIKE 'http%'").distinct().withColumn("is_folder", F.col("name").endswith("/"))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with the file they came from; blank lines are skipped, lines that are no object are kept as errors."""
    raw = spark.read.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), "value")
    return raw.select("file", F.from_json("value", schema).alias("r"), (~F.ltrim("value").startswith("{")).alias("is_error"))


def profile_jsonl(spark: SparkSession, path: str, text_key: str, id_key: str) -> DataFrame:
    """Records, records with text and records with an id, per file."""
    raw = spark.read.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), "value")
    has = lambda key: F.count_if(F.trim(F.get_json_object("value", f"$.{key}")) != "")
    return raw.groupBy("file").agg(F.count(F.lit(1)).alias("records"), has(text_key).alias("text_records"), has(id_key).alias("id_records"))


#: The fixed header of a seismic record (public SEED format, version 2), big-endian.
RECORD_HEADER = np.dtype(
    {
        "names": ["station", "channel", "year", "day", "hour", "minute", "second", "ticks", "samples", "factor", "multiplier", "blockette"],
        "formats": ["S5", "S3", ">u2", ">u2", "u1", "u1", "u1", ">u2", ">u2", ">i2", ">i2", ">u2"],
        "offsets": [8, 15, 20, 22, 24, 25, 26, 28, 30, 32, 34, 46],
        "itemsize": 48,
    }
)
RECORD_BLOCKETTE = 1000


def _records(content: bytes, default: int) -> np.ndarray:
    """The headers of a file's records in native byte order; a record's order shows in its year."""
    heads, at = [], 0
    while at + RECORD_HEADER.itemsize <= len(content):
        head = np.frombuffer(content, RECORD_HEADER, 1, at)
        order = "big" if 1900 < head["year"][0] < 2100 else "little"
        heads.append(head if order == "big" else head.view(RECORD_HEADER.newbyteorder("<")))
        number = lambda i: int.from_bytes(content[i : i + 2], order)  # noqa: B023, E731
        link, length = number(at + 46), default
        while link and at + link + 8 <= len(content):
            if number(at + link) == RECORD_BLOCKETTE:
                length = 1 << content[at + link + 6]
                break
            link = number(at + link + 2)
        at += length
    native = RECORD_HEADER.newbyteorder("=")
    return np.concatenate([h.astype(native) for h in heads]) if heads else np.zeros(0, native)


def _rates(factor: np.ndarray, multiplier: np.ndarray) -> np.ndarray:
    """Samples a second: positive numbers multiply, negative ones divide, zero means none."""
    part = lambda x: np.where(x > 0, x, -1.0 / np.where(x < 0, x, -1)) * (x != 0)
    return part(factor.astype(float)) * part(multiplier.astype(float))


def packet_spans(files: DataFrame, record_length: int = 512) -> DataFrame:
    """Spans of seismic records from ``binaryFile`` rows: (path, station, channel, start, end, rate).

    Either byte order is read; a record without samples or rate gives no span. ``record_length``
    holds where a record does not state its own.
    """
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                h = _records(bytes(content), record_length)
                rate = _rates(h["factor"], h["multiplier"])
                h, rate = h[(rate > 0) & (h["samples"] > 0)], rate[(rate > 0) & (h["samples"] > 0)]
                days = (h["year"].astype("i8") - 1970).astype("datetime64[Y]").astype("datetime64[D]").astype("i8") + h["day"] - 1
                start = days * 86400.0 + h["hour"] * 3600.0 + h["minute"] * 60.0 + h["second"] + h["ticks"] / 1e4
                name = lambda c: [x.decode("ascii", "replace").strip() for x in h[c].tolist()]  # noqa: B023, E731
                if len(h):
                    yield pd.DataFrame({"path": path, "station": name("station"), "channel": name("channel"), "start": start, "end": start + h["samples"] / rate, "rate": rate})

    return files.select("path", "content").mapInPandas(run, "path string, station string, channel string, start double, end double, rate double")
