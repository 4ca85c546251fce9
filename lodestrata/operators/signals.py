"""Filters and fits on long series, cut into blocks: no series is ever one task's.

A recursive filter is a linear system: what a block leaves behind is what it leaves from rest
plus a matrix power times what it began with. So every block is run from rest for its last
state, those few numbers are carried along the series, and every block is run again from its
true beginning. The result is that of the serial filter at any block length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize
from ..sources.shipping import ship

BLOCK = 1 << 16
STEP = 256
BLOCKS = "series string, block long, first long, x array<double>"

#: Public speeds of the main tides, in cycles an hour.
TIDES = {
    "M2": 0.0805114006717706, "S2": 0.0833333333333333, "N2": 0.0789992486986775, "K2": 0.0835614924155182,
    "K1": 0.0417807462216577, "O1": 0.0387306544501129, "P1": 0.0415525871116756, "Q1": 0.0372185024787343,
}


def butterworth(order: int, low: float, high: float, rate: float) -> np.ndarray:
    """Second-order sections (b0, b1, b2, a1, a2) of a band-pass: prototype poles, band transform, bilinear map."""
    warped = 2 * rate * np.tan(np.pi * np.array([low, high]) / rate)
    width, centre = warped[1] - warped[0], math.sqrt(warped[0] * warped[1])
    prototype = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)) * width / 2
    spread = np.sqrt(prototype**2 - centre**2)
    poles = np.concatenate([prototype + spread, prototype - spread])
    digital = (2 * rate + poles) / (2 * rate - poles)
    gain = np.real((width * 2 * rate) ** order / np.prod(2 * rate - poles))
    upper = digital[digital.imag > 0]
    real = np.sort(digital[digital.imag == 0].real)
    pairs = [(2 * p.real, -(abs(p) ** 2)) for p in upper[np.argsort(np.abs(upper))]] + [(real[i] + real[i + 1], -real[i] * real[i + 1]) for i in range(0, len(real) - 1, 2)]
    each = gain ** (1 / len(pairs))
    return np.array([(each, 0.0, -each, -a, -b) for a, b in pairs])


class System:
    """s' = A s + b u, y = c s + d u, run over whole steps by matrix products."""

    def __init__(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: float):
        self.a, self.n = a, len(a)
        powers = [np.eye(self.n)]
        for _ in range(STEP):
            powers.append(a @ powers[-1])
        self.powers = powers
        impulse = np.array([d] + [c @ powers[k] @ b for k in range(STEP - 1)])
        at = np.arange(STEP)[:, None] - np.arange(STEP)
        self.direct = np.where(at >= 0, impulse[np.maximum(at, 0)], 0.0)
        self.seen = np.array([c @ powers[k] for k in range(STEP)])
        self.reach = np.array([powers[k] @ b for k in range(STEP)]).T
        self.rest = np.linalg.solve(np.eye(self.n) - a, b) if abs(np.linalg.det(np.eye(self.n) - a)) > 1e-300 else np.zeros(self.n)

    @classmethod
    def sections(cls, sections: np.ndarray) -> System:
        n = 2 * len(sections)
        a, b, c, d = np.zeros((n, n)), np.zeros(n), np.zeros(n), 1.0
        for i, (b0, b1, b2, a1, a2) in enumerate(sections):
            # The section's input is the output so far, c s + d u; its own output adds its first state.
            own = slice(2 * i, 2 * i + 2)
            gain = np.array([b1 - a1 * b0, b2 - a2 * b0])
            a[own] = np.outer(gain, c)
            a[own, own] += np.array([[-a1, 1.0], [-a2, 0.0]])
            b[own] = gain * d
            c, d = b0 * c, b0 * d
            c[2 * i] += 1.0
        return cls(a, b, c, d)

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = np.empty(len(x))
        for lo in range(0, len(x), STEP):
            part = x[lo : lo + STEP]
            n = len(part)
            y[lo : lo + n] = self.direct[:n, :n] @ part + self.seen[:n] @ state
            state = self.powers[n] @ state + self.reach[:, :n][:, ::-1] @ part
        return y, state

    def after(self, n: int) -> np.ndarray:
        return np.linalg.matrix_power(self.a, n)


def blocks(samples: DataFrame, length: int = BLOCK) -> DataFrame:
    """series, block, first, x from rows of series, n (0, 1, ...) and x."""
    own = samples.groupBy(F.col("series").cast("string").alias("series"), F.floor(F.col("n") / length).cast("long").alias("block"))
    rows = own.agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("rows"))  # at most ``length`` rows
    return rows.select("series", "block", F.get("rows", F.lit(0))["n"].cast("long").alias("first"), F.transform("rows", lambda r: r["x"].cast("double")).alias("x"))


def filtered(held: DataFrame, system: System, settled: bool, backward: bool = False) -> DataFrame:
    """The blocks with their filter's output; ``settled``: each series begins as if its first sample had stood for ever."""
    ship(held.sparkSession)
    n = system.n
    sign = -1 if backward else 1

    def turn(x: np.ndarray) -> np.ndarray:
        return x[::-1] if backward else x

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = [turn(np.array(x)) for x in batch.column("x").to_pylist()]
            last = [system.run(x, np.zeros(n))[1].tolist() for x in xs]
            yield pa.RecordBatch.from_arrays([batch.column("series"), batch.column("block"), pa.array([len(x) for x in xs], pa.int64()), pa.array([float(x[0]) for x in xs]), pa.array(last, pa.list_(pa.float64()))], ["series", "block", "length", "head", "last"])

    left = held.mapInArrow(leave, "series string, block long, length long, head double, last array<double>")

    def carry(table: pa.Table) -> pa.Table:
        """One series: a few numbers a block."""
        rows = sorted(table.to_pylist(), key=lambda r: sign * r["block"])
        state = system.rest * rows[0]["head"] if settled else np.zeros(n)
        powers: dict[int, np.ndarray] = {}
        begins = []
        for r in rows:
            begins.append(state.tolist())
            if r["length"] not in powers:
                powers[r["length"]] = system.after(r["length"])
            state = powers[r["length"]] @ state + np.array(r["last"])
        return pa.table({"series": pa.array([r["series"] for r in rows], pa.string()), "block": pa.array([r["block"] for r in rows], pa.int64()), "state": pa.array(begins, pa.list_(pa.float64()))})

    states = left.groupBy("series").applyInArrow(carry, "series string, block long, state array<double>")

    def pass_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("x").to_pylist(), batch.column("state").to_pylist(), strict=True)
            y = [turn(system.run(turn(np.array(x)), np.array(s))[0]).tolist() for x, s in pairs]
            yield pa.RecordBatch.from_arrays([batch.column("series"), batch.column("block"), batch.column("first"), pa.array(y, pa.list_(pa.float64()))], ["series", "block", "first", "x"])

    return materialize(held.join(states, ["series", "block"]).mapInArrow(pass_, BLOCKS), "filtered")


def rows_of(held: DataFrame) -> DataFrame:
    return held.select("series", "first", F.posexplode("x").alias("at", "x")).select("series", (F.col("first") + F.col("at")).alias("n"), "x")


def extended(samples: DataFrame, sizes: DataFrame, pad: int) -> DataFrame:
    """``samples`` with ``pad`` rows before and after each series, mirrored through its end points; n begins at 0 again.

    ``sizes`` has series, size, head and tail (the end points); a series of ``pad`` rows or fewer has no extension and goes.
    """
    s = samples.join(sizes.where(F.col("size") > pad), "series")
    n, x, size = F.col("n"), F.col("x"), F.col("size")
    before = s.where(n.between(1, pad)).select("series", (pad - n).alias("n"), (2 * F.col("head") - x).alias("x"))
    after = s.where(n.between(size - 1 - pad, size - 2)).select("series", (2 * (size - 1) - n + pad).alias("n"), (2 * F.col("tail") - x).alias("x"))
    return s.select("series", (n + pad).alias("n"), "x").unionByName(before).unionByName(after)


def bandpass(samples: DataFrame, rate: float, low: float, high: float, order: int = 4, length: int = BLOCK) -> DataFrame:
    """series, n, x: zero-phase band-pass of rows of series, n (0, 1, ...) and x.

    The mean goes, 5 % at each end are tapered by half a cosine, and the filter runs forward and backward over the
    series mirrored through its end points. A series too short to be mirrored has no rows.
    """
    samples = samples.select(F.col("series").cast("string").alias("series"), "n", F.col("x").cast("double").alias("x"))
    of = samples.groupBy("series").agg(F.count(F.lit(1)).alias("size"), F.avg("x").alias("mean"))
    n, size = F.col("n"), F.col("size")
    taper = F.greatest(F.lit(1), (size * 0.05).cast("long"))
    near = F.least(n, size - 1 - n)
    angle = F.when(taper > 1, near * math.pi / (taper - 1)).otherwise(0.0)
    shaped = (F.col("x") - F.col("mean")) * F.when(near < taper, 0.5 * (1 - F.cos(angle))).otherwise(1.0)
    tapered = samples.join(of, "series").select("series", "n", shaped.alias("x"), "size")
    ends = tapered.groupBy("series").agg(F.max("size").alias("size"), F.max(F.when(n == 0, F.col("x"))).alias("head"), F.max(F.when(n == size - 1, F.col("x"))).alias("tail"))
    sections = butterworth(order, low, high, rate)
    pad = 3 * (2 * len(sections) + 1)
    system = System.sections(sections)
    held = materialize(blocks(extended(tapered.drop("size"), ends, pad), length), "blocks")
    both = filtered(filtered(held, system, True), system, True, backward=True)
    out = rows_of(both).join(ends.select("series", "size"), "series")
    return out.where(n.between(pad, F.col("size") + pad - 1)).select("series", (n - pad).alias("n"), "x")


def recursive_ratio(samples: DataFrame, short: int, long: int, length: int = BLOCK) -> DataFrame:
    """series, n, ratio: short over long running mean of squares, each the last one moved towards the new square by 1 / its length; 0 in the first ``long`` rows."""
    squares = blocks(samples.select("series", "n", (F.col("x").cast("double") ** 2).alias("x")), length)
    held = materialize(squares, "squares")
    means = [rows_of(filtered(held, System(np.array([[1 - 1 / k]]), np.array([(1 - 1 / k) / k]), np.array([1.0]), 1 / k), False)).withColumnRenamed("x", f"m{i}") for i, k in enumerate((short, long))]
    both = means[0].join(means[1], ["series", "n"])
    return both.select("series", "n", F.when(F.col("n") >= long, F.col("m0") / F.when(F.col("m1") > 0, F.col("m1")).otherwise(2.2250738585072014e-308)).otherwise(0.0).alias("ratio"))


def _basis(hours: Column, speeds: dict[str, float]) -> list[Column]:
    waves = [f(F.lit(2 * math.pi * v) * hours) for v in speeds.values() for f in (F.cos, F.sin)]
    return [F.lit(1.0), hours / 8766.0, *waves]


def tides(samples: DataFrame, speeds: dict[str, float] | None = None) -> DataFrame:
    """series, hours, x, tide, mean_and_trend by least squares on waves of the given speeds, a mean and a trend; rows of series, hours, x.

    One pass adds up the products of the basis, a fixed number of sums a series whatever its length; they are solved once a
    series. Null x takes no part in the fit and is predicted. Too few rows leave the least coefficients that fit.
    """
    speeds = speeds or TIDES
    k = 2 + 2 * len(speeds)
    basis = _basis(F.col("hours"), speeds)
    at = samples.select("series", "hours", F.col("x").cast("double").alias("x"), F.array(*basis).alias("b"))
    b = [F.get("b", F.lit(i)) for i in range(k)]
    fitted = at.where("x IS NOT NULL").groupBy("series").agg(*[F.sum(b[i] * b[j]).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(b[i] * F.col("x")).alias(f"q{i}") for i in range(k)])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                p = np.array([[row[f"p{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
                scale = 1 / np.sqrt(np.maximum(np.diag(p), 1e-300))
                p, q = p * np.outer(scale, scale), np.array([row[f"q{i}"] for i in range(k)]) * scale
                out.append((np.linalg.lstsq(p, q, rcond=1e-13)[0] * scale).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("series"), pa.array(out, pa.list_(pa.float64()))], ["series", "c"])

    solved = fitted.mapInArrow(solve, f"series {at.schema['series'].dataType.simpleString()}, c array<double>")
    c = [F.get("c", F.lit(i)) for i in range(k)]
    wave = sum((c[i] * b[i] for i in range(2, k)), F.lit(0.0))
    return at.join(solved, "series").select("series", "hours", "x", wave.alias("tide"), (c[0] * b[0] + c[1] * b[1]).alias("mean_and_trend"))
