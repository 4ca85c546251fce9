"""Samples of records: round trips, every layout, damage, and segments."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.sources import packets


def ramp(kind):
    rng = np.random.default_rng(kind)
    if kind == 0:
        return rng.integers(-3, 4, 900).cumsum()
    if kind == 1:
        return rng.integers(-(1 << 28), 1 << 28, 50)
    steps = np.concatenate([rng.integers(-(1 << b), 1 << b, 40) for b in (2, 3, 4, 6, 8, 12, 20, 3)])
    return steps.cumsum()


@pytest.mark.parametrize("encoding", [packets.STEIM1, packets.STEIM2])
@pytest.mark.parametrize("kind", [0, 1, 2])
def test_frames_round_trip(encoding, kind):
    x = ramp(kind)
    data, n = packets.pack(x, int(x[0]), 400, encoding)
    assert n == len(x)
    assert packets.unpack(data, n, encoding, ">").tolist() == x.tolist()
    little = np.frombuffer(data, ">u4").astype("<u4").tobytes()
    assert packets.unpack(little, n, encoding, "<").tolist() == x.tolist()
    with pytest.raises(ValueError, match="last sample"):
        packets.unpack(data, n - 1 if x[-1] != x[-2] else n - 2, encoding, ">")
    with pytest.raises(ValueError, match="short"):
        packets.unpack(data[:64], n, encoding, ">")


def test_plain_encodings():
    x = np.array([1, -2, 300])
    for code, kind in packets.PLAIN.items():
        assert packets.unpack(x.astype(np.dtype(kind).newbyteorder(">")).tobytes(), 3, code, ">").tolist() == [1, -2, 300]
    with pytest.raises(ValueError):
        packets.unpack(b"", 1, 99, ">")


def test_records_and_segments(spark):
    a, b = ramp(0), ramp(2)
    rows = [("HHZ", 1_700_000_000, a.tolist()), ("HHZ", 1_700_000_500, b.tolist()), ("HHN", 1_700_000_000, b.tolist()), ("HHE", 5, [])]
    df = spark.createDataFrame(rows, "series string, start long, samples array<long>")
    files = packets.write_records(df, 10).select(F.concat("series", F.monotonically_increasing_id()).alias("path"), "content")
    found = packets.decoded_records(files)
    assert found.where("problem IS NOT NULL").count() == 0
    got = {}
    for r in sorted(packets.segments(found).collect(), key=lambda r: r.start):
        got.setdefault((r.channel, r.segment), []).extend(r.samples)
    assert {k: v for k, v in got.items()} == {("HHZ", 1): a.tolist(), ("HHZ", 2): b.tolist(), ("HHN", 1): b.tolist()}
    longest = sorted(packets.longest_segment(found).where("channel = 'HHZ'").collect(), key=lambda r: r.start)
    assert [x for r in longest for x in r.samples] == a.tolist() and longest[0].start == 1_700_000_000.0 and longest[0].rate == 10.0


def test_a_damaged_record_tells_its_problem(spark):
    df = spark.createDataFrame([("HHZ", 0, ramp(0).tolist())], "series string, start long, samples array<long>")
    content = bytearray(packets.write_records(df, 10).first().content)
    content[64 + 200] ^= 1
    rows = spark.createDataFrame([("f", content), ("short", bytearray(b"x"))], "path string, content binary")
    found = packets.decoded_records(rows).orderBy("start").collect()
    assert [r.problem for r in found][:1] == ["last sample differs"] and all(r.problem is None for r in found[1:]) and found[0].samples is None


def test_few_samples_unpack_like_many(monkeypatch):
    rng = np.random.default_rng(8)
    for encoding in (packets.STEIM1, packets.STEIM2):
        for n in (1, 2, 5, 60):
            x = rng.integers(-(1 << int(rng.integers(2, 27))), 1 << 27, n).cumsum() // 8 if n > 5 else rng.integers(-300, 300, n)
            data, held = packets.pack(x, int(x[0]), 7, encoding)
            data = data.ljust(448, b"\0")
            few = packets.unpack_few(data, held, encoding, ">").tolist()
            monkeypatch.setattr(packets, "FEW", -1)
            assert few == packets.unpack(data, held, encoding, ">").tolist() == x[:held].tolist()
            monkeypatch.undo()
    # A long series costs a record's share at each record, not all that is left of it.
    long = np.zeros(4_000_000, np.int64)
    start = time.perf_counter()
    for at in range(0, 100_000, 1000):
        packets.pack(long[at:], 0, 7, packets.STEIM2)
    assert time.perf_counter() - start < 5
