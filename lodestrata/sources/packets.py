"""Seismic records with samples: written and read in steps over whole arrays.

A record is a header of 48 bytes, a block that names encoding, byte order and length, and 64-byte
frames of sixteen words. A frame's first word tells by two bits for each word how many differences
it packs; the first frame also holds the first and the last sample. All frames of a record are
unpacked at once: words of one layout together, their differences put where a running count of
differences says, and one running sum gives the samples.
"""

from __future__ import annotations

import itertools
import struct
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalogs import RECORD_BLOCKETTE, RECORD_HEADER
from .shipping import ship

#: Encodings by their public numbers; plain ones with their types.
PLAIN = {1: "i2", 3: "i4", 4: "f4", 5: "f8"}
STEIM1, STEIM2 = 10, 11
#: (differences, bits of each) by the frame's two bits, and for the second form by the word's own two bits where it has some.
LAYOUTS = {
    STEIM1: {(1, None): (4, 8), (2, None): (2, 16), (3, None): (1, 32)},
    STEIM2: {(1, None): (4, 8), (2, 1): (1, 30), (2, 2): (2, 15), (2, 3): (3, 10), (3, 0): (5, 6), (3, 1): (6, 5), (3, 2): (7, 4)},
}
FRAMES_AT = 64
#: Fixed value: records of up to so many samples are unpacked word by word.
FEW = 100
RECORDS = "path string, station string, channel string, start double, rate double, samples array<double>, problem string"


def unpack_few(data: bytes, count: int, encoding: int, order: str) -> np.ndarray:
    """``unpack`` of a record of few samples, word by word: steps over whole arrays cost more than so few words."""
    words = struct.unpack_from(f"{order}{len(data) // 64 * 16}I", data)
    if not words:
        raise ValueError("short data")
    layouts, steps = LAYOUTS[encoding], []
    for frame in range(0, len(words), 16):
        codes = words[frame] & 0x3FFFFFFF
        if frame == 0:
            codes &= 0x03FFFFFF  # the first and the last sample
        for place in range(1, 16) if codes else ():
            code = codes >> 2 * (15 - place) & 3
            if not code:
                continue
            word = words[frame + place]
            layout = layouts.get((code, None)) or layouts.get((code, word >> 30))
            if layout is None:
                raise ValueError("unknown layout")
            n, bits = layout
            half = 1 << bits - 1
            steps += [((word >> bits * (n - 1 - k) & 2 * half - 1) ^ half) - half for k in range(n)]
    if len(steps) < count:
        raise ValueError("short data")
    first, last = ((w ^ 1 << 31) - (1 << 31) for w in words[1:3])
    out = list(itertools.accumulate(steps[1:count], initial=first)) if count else []
    if count and out[-1] != last:
        raise ValueError("last sample differs")
    return np.array(out, float)


def unpack(data: bytes, count: int, encoding: int, order: str) -> np.ndarray:
    """``count`` samples of a record's data; ValueError where they do not end in the sample that the record names."""
    if encoding in PLAIN:
        kind = np.dtype(PLAIN[encoding]).newbyteorder(order)
        if len(data) < count * kind.itemsize:
            raise ValueError("short data")
        return np.frombuffer(data, kind, count).astype(float)
    if encoding not in LAYOUTS:
        raise ValueError(f"encoding {encoding}")
    if count <= FEW:
        return unpack_few(data, count, encoding, order)
    words = np.frombuffer(data[: len(data) // 64 * 64], np.dtype("u4").newbyteorder(order)).astype(np.uint32).reshape(-1, 16)
    if not len(words):
        raise ValueError("short data")
    codes = ((words[:, :1] >> np.arange(30, -2, -2, dtype=np.uint32)) & 3).astype(np.int64)
    codes[:, 0] = 0
    first, last = words[0, 1:3].astype(np.uint32).view(np.int32)
    codes[0, 1:3] = 0
    flat, codes = words.ravel(), codes.ravel()
    inner = (flat >> 30).astype(np.int64)
    sizes = np.zeros(len(flat), np.int64)
    chosen = []
    for (code, own), (n, bits) in LAYOUTS[encoding].items():
        mine = np.flatnonzero((codes == code) & ((inner == own) if own is not None else True))
        sizes[mine] = n
        chosen.append((mine, n, bits))
    if ((codes > 0) & (sizes == 0)).any():
        raise ValueError("unknown layout")
    before = np.cumsum(sizes) - sizes
    steps = np.zeros(int(sizes.sum()), np.int64)
    for mine, n, bits in chosen:
        for k in range(n):
            shift = np.uint32(bits * (n - 1 - k))
            raw = (flat[mine] >> shift).astype(np.int64) & ((1 << bits) - 1)
            steps[before[mine] + k] = raw - ((raw >> (bits - 1)) << bits)
    if len(steps) < count:
        raise ValueError("short data")
    steps = steps[:count]
    if count:
        steps[0] = first
    out = np.cumsum(steps)
    if count and out[-1] != last:
        raise ValueError("last sample differs")
    return out.astype(float)


def pack(samples: np.ndarray, before: int, frames: int, encoding: int) -> tuple[bytes, int]:
    """(frames of data, samples that fit) for whole numbers, each word packing as many differences as fit."""
    layouts = sorted(LAYOUTS[encoding].items(), key=lambda kv: -kv[1][0])
    samples = samples[: frames * 15 * layouts[0][1][0]].tolist()  # no record holds more
    steps = [x - y for x, y in zip(samples, [before, *samples], strict=False)]
    widths = [(d if d >= 0 else ~d).bit_length() + 1 for d in steps]
    words, at, used = [0] * (frames * 16), 0, 0
    for frame in range(frames):
        if at == len(steps):
            break
        for place in range(3 if frame == 0 else 1, 16):
            for (code, own), (n, bits) in layouts:
                if at + n <= len(steps) and max(widths[at : at + n]) <= bits:
                    break
            else:
                if at < len(steps):
                    raise ValueError("a difference is too large")
                break
            word = 0 if own is None else own << 30
            for k, d in enumerate(steps[at : at + n]):
                word |= (d & ((1 << bits) - 1)) << (bits * (n - 1 - k))
            words[frame * 16 + place] = word
            words[frame * 16] |= code << (2 * (15 - place))
            at += n
            used = frame + 1
    if not all(-(1 << 31) <= samples[i] < 1 << 31 for i in (0, at - 1)):
        raise OverflowError("a sample is too large")
    words[1:3] = samples[0] & 0xFFFFFFFF, samples[at - 1] & 0xFFFFFFFF
    used = max(used, 1) * 16
    return struct.pack(f">{used}I", *words[:used]), at


def write_records(series: DataFrame, rate: int, encoding: int = STEIM2, length: int = 512) -> DataFrame:
    """series, content: the records of each row of series (its channel), start (whole seconds) and samples (whole numbers)."""
    ship(series.sparkSession)

    def one(name: str, start: int, samples: np.ndarray) -> bytes:
        out, at, before = [], 0, int(samples[0]) if len(samples) else 0
        while at < len(samples):
            data, n = pack(samples[at:], before, (length - FRAMES_AT) // 64, encoding)
            seconds, ticks = divmod(at * 10_000 // rate, 10_000)
            when = time.gmtime(start + seconds)
            fields = b"000001D ", b"STA", name.encode()[:3], when.tm_year, when.tm_yday, when.tm_hour, when.tm_min, when.tm_sec, ticks, n, rate, 1, FRAMES_AT, 48
            record = struct.pack(">8s5s2x3s2xHHBBBxHHhh8xHHHHBBBB8x", *fields, RECORD_BLOCKETTE, 0, encoding, 1, length.bit_length() - 1, 0)
            out.append((record + data).ljust(length, b"\0"))
            at, before = at + n, int(samples[at + n - 1])
        return b"".join(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("series", "start", "samples")), strict=True)
            content = [one(name, start, np.array(samples, np.int64)) for name, start, samples in rows]
            yield pa.RecordBatch.from_arrays([batch.column("series"), pa.array(content, pa.binary())], ["series", "content"])

    return series.select("series", "start", "samples").mapInArrow(run, "series string, content binary")


def _decoded(path: str, content: bytes, record_length: int) -> Iterator[tuple]:
    """The rows of ``RECORDS`` of one file; a record's byte order shows in its year."""
    at = 0
    while at + RECORD_HEADER.itemsize <= len(content):
        order = ">" if 1900 < int.from_bytes(content[at + 20 : at + 22], "big") < 2100 else "<"
        station, channel, year, day, hour, minute, second, ticks, count, factor, multiplier, data_at, link = struct.unpack_from(f"{order}8x5s2x3s2xHHBBBxHHhh8xHH", content, at)
        length, encoding, words = record_length, 3, order
        while link and at + link + 8 <= len(content):
            kind, following, own, big, power = struct.unpack_from(f"{order}HHBBB", content, at + link)
            if kind == RECORD_BLOCKETTE:
                encoding, length, words = own, 1 << power, ">" if big else "<"
                break
            link = following
        part = lambda x: x if x > 0 else -1.0 / x if x else 0.0
        rate = float(part(factor) * part(multiplier))
        if rate > 0 and count:
            years = year - 1
            days = 365 * years + years // 4 - years // 100 + years // 400 - 719_162 + day - 1
            problem, samples = None, None
            try:
                samples = unpack(content[at + data_at : at + length], count, encoding, words).tolist()
            except ValueError as e:
                problem = str(e)
            text = lambda b: b.rstrip(b"\0").decode("ascii", "replace").strip()
            yield path, text(station), text(channel), days * 86400.0 + hour * 3600 + minute * 60 + second + ticks / 1e4, rate, samples, problem
        at += length


def decoded_records(files: DataFrame, record_length: int = 512) -> DataFrame:
    """One row a record of ``files`` (path, content) with its samples; a record that cannot be read has a ``problem`` and none.

    ``record_length`` and plain whole numbers hold where a record does not state its own. Records without samples or rate are left out.
    """
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                out += _decoded(path, content, record_length)
                if len(out) >= 1000:
                    yield table(out)
                    out = []
            if out:
                yield table(out)

    def table(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.string()]
        columns = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in RECORDS.split(", ")])

    return files.select("path", "content").mapInArrow(run, RECORDS)


def segments(records: DataFrame) -> DataFrame:
    """``records`` with the number of their segment: one goes on while the next record starts where the last one ended, within half a sample."""
    order = Window.partitionBy("station", "channel").orderBy("start", "path")
    end = F.col("start") + F.size("samples") / F.col("rate")
    gap = F.abs(F.col("start") - F.lag(end).over(order)) > 0.5 / F.col("rate")
    opens = F.coalesce(gap | (F.lag("rate").over(order) != F.col("rate")), F.lit(True))
    own = records.where("problem IS NULL").withColumn("_opens", opens.cast("int"))
    return own.withColumn("segment", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def longest_segment(records: DataFrame) -> DataFrame:
    """The records of each channel's segment with most samples, ties to the earlier."""
    own = segments(records)
    sizes = own.groupBy("station", "channel", "segment").agg(F.sum(F.size("samples")).alias("samples"))
    best = sizes.groupBy("station", "channel").agg(F.min_by("segment", F.struct(-F.col("samples"), "segment")).alias("segment"))
    return own.join(best, ["station", "channel", "segment"], "left_semi")
