"""Operator 11: embedding whitening by a matrix-free block Lanczos iteration.

Entries become integers x = floor(64 c) + 1000000, so sums and deviations are exact. The
covariance matrix is never formed: a pass over the vectors centres each one, multiplies
it with a block of directions, and adds up X'(Xv); only that block, dimensions times
block width, meets the driver. The iteration keeps its basis orthogonal in full, starts
a direction anew where a block loses rank, and ends when the residuals of the wanted
components are at double precision or the basis spans the whole space. A block is wider
than the number of components, so equal eigenvalues are found as often as they stand. The
trace comes from the rows' deviations, which gives the explained shares without the
other eigenvalues.

A row is centred as (x - q) - r / n, where the sum of its dimension is q n + r: the first
difference is a whole number, so nothing is lost to the size of x.

Defined cases: rows whose vector is null or holds a null or non-finite entry are dropped,
and so are empty vectors and those whose length is not the commonest (of equally common
lengths the longest stays); repeated rows and null ids count and are returned each; equal
eigenvalues may share their plane in any way; directions without variance (eigenvalue
under 1e-12 of the largest) have no component, so one row, or equal rows, give none; an
empty table gives none; entries beyond 2**40 after scaling are clipped to that; a
deviation beyond a long is null; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MOST_COMPONENTS = 32
SPARE = 8
RESIDUAL = 1e-14
NO_VARIANCE = 1e-12
ENTRIES = 1 << 20
CLIP = float(1 << 40)
LONG_MAX = (1 << 63) - 1
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, x: the rows that take part, in whole numbers."""
    c = F.col("embedding").cast("array<double>")
    finite = c.isNotNull() & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    x = F.transform(c, lambda e: F.floor(F.greatest(F.least(F.lit(64.0) * e, F.lit(CLIP)), F.lit(-CLIP))) + F.lit(1_000_000))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(finite, x).alias("x")).where(F.size("x") > 0)


class Moments:
    """Row count and per-dimension sums, and rows centred by them."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)**2 for each row, exact.

        The sums run modulo 2**64, which is exact for every result that fits a long; rows near or
        beyond that are told by their size and computed in unbounded integers.
        """
        with np.errstate(over="ignore"):
            d = np.int64(self.n) * (x - self.whole) - self.rest
            out = (d * d).sum(axis=1).tolist()
        size = self.squares(x) * float(self.n) ** 2
        for i in np.flatnonzero(size > 9e18).tolist():
            exact = sum((self.n * a - b) ** 2 for a, b in zip((x[i] - self.whole).tolist(), self.rest.tolist(), strict=True))
            out[i] = exact if exact <= LONG_MAX else None
        return out

    def squares(self, x: np.ndarray) -> np.ndarray:
        """The deviations over n squared, as doubles."""
        return (self.centred(x) ** 2).sum(axis=1)


def matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, rows of x) in runs of bounded size."""
    step = max(1, ENTRIES // width)
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            yield part.column("vec_id"), part.column("x").flatten().to_numpy().reshape(part.num_rows, width)


def add_up(x: DataFrame, shape: tuple[int, int], of_rows: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum of ``of_rows`` over all rows: each task adds up its own, Spark adds the tasks' cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for _, rows in matrices(batches, width):
            total += of_rows(rows)
        cells = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total.ravel())], ["cell", "value"])

    cells = x.mapInArrow(common.tidy(run), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    out = np.zeros(shape[0] * shape[1])
    for cell, value in cells.collect():  # dimensions x block width
        out[cell] = value
    return out.reshape(shape)


def moments(x: DataFrame, width: int) -> Moments:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for _, rows in matrices(batches, width):
            n += len(rows)
            total = [a + b for a, b in zip(total, rows.sum(axis=0).tolist(), strict=True)]  # a run sums below 2**63
        sums = [str(v) for v in [n, *total]]
        yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int32()), pa.array(sums)], ["dimension", "total"])

    added = x.mapInArrow(common.tidy(run), "dimension int, total string").groupBy("dimension").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = dict(added.collect())
    return Moments(int(found[0]), [int(found[j + 1]) for j in range(width)])


def fresh_directions(rng: np.random.Generator, basis: np.ndarray, count: int) -> np.ndarray:
    """``count`` random directions orthogonal to ``basis`` and to each other."""
    out = rng.standard_normal((len(basis), count))
    for _ in range(3):
        out -= basis @ (basis.T @ out)
        out = np.linalg.qr(out)[0]
    return out


def next_block(rng: np.random.Generator, rest: np.ndarray, basis: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(directions, factor): rest = directions @ factor, orthogonal to ``basis``.

    Where ``rest`` loses rank its lost directions are replaced by fresh ones with a factor of zero.
    """
    room = min(rest.shape[1], len(basis) - basis.shape[1])
    left, sizes, right = np.linalg.svd(rest, full_matrices=False)
    kept = int((sizes[:room] > 1e-13 * scale).sum())
    block = left[:, :kept]
    for _ in range(2):
        block = np.linalg.qr(block - basis @ (basis.T @ block))[0] if kept else block
    factor = np.zeros((room, rest.shape[1]))
    factor[:kept] = block.T @ rest
    if kept < room:
        block = np.hstack([block, fresh_directions(rng, np.hstack([basis, block]), room - kept)])
    return block, factor


def lanczos(apply: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``wanted`` largest eigenpairs of a symmetric operator, and the number of passes.

    The projected matrix is block tridiagonal: each pass gives a diagonal block and, from what is
    left after full reorthogonalisation, the block below it.
    """
    rng = np.random.default_rng(seed)
    block = fresh_directions(rng, np.zeros((width, 0)), min(width, wanted + SPARE))
    basis, projected, passes = block, np.zeros((0, 0)), 0
    while True:
        image = apply(block)
        passes += 1
        size, before = basis.shape[1], basis.shape[1] - block.shape[1]
        grown = np.zeros((size, size))
        grown[:before, :before] = projected[:before, :before]
        if before:
            lower = projected[before:, :before]
            grown[before:, :before], grown[:before, before:] = lower, lower.T
        diagonal = block.T @ image
        grown[before:, before:] = (diagonal + diagonal.T) / 2
        rest = image - basis @ (basis.T @ image)
        rest -= basis @ (basis.T @ rest)
        values, vectors = np.linalg.eigh(grown)
        values, vectors = values[::-1][:wanted], vectors[:, ::-1][:, :wanted]
        scale = max(float(values[0]), 0.0) if len(values) else 0.0
        residuals = np.linalg.norm(rest @ vectors[before:], axis=0)
        if size == width or scale == 0.0 or (residuals <= RESIDUAL * scale * width**0.5).all():
            return values, basis @ vectors, passes
        following, factor = next_block(rng, rest, basis, scale)
        projected = np.zeros((size + following.shape[1], size))
        projected[:size, :size] = grown
        projected[size:, before:] = factor
        basis, block = np.hstack([basis, following]), following


class Components:
    """Unit eigenvectors (columns), eigenvalues and the total variance."""

    def __init__(self, moments: Moments, values: np.ndarray, vectors: np.ndarray, trace: float, passes: int):
        largest = np.abs(vectors).argmax(axis=0)
        sign = np.sign(vectors[largest, np.arange(vectors.shape[1])])
        self.moments, self.values, self.vectors = moments, values, vectors * sign
        self.explained = values / trace if trace > 0 else values
        self.passes = passes

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.moments.centred(x) @ (self.vectors / np.sqrt(self.values))


def fit(x: DataFrame, width: int, components: int = MOST_COMPONENTS) -> Components:
    """Eigenpairs of the covariance of ``x``, by passes over it."""
    held = moments(x, width)
    n = held.n
    trace = float(add_up(x, (1, 1), lambda rows: held.squares(rows).sum(), width)[0, 0]) / n

    def covariance(directions: np.ndarray) -> np.ndarray:
        def of_rows(rows: np.ndarray) -> np.ndarray:
            centred = held.centred(rows)
            return centred.T @ (centred @ directions)

        return add_up(x, directions.shape, of_rows, width) / n

    values, vectors, passes = lanczos(covariance, width, min(components, width))
    real = values > NO_VARIANCE * max(values[0], 0.0)
    return Components(held, values[real], vectors[:, real], trace, passes)


def identity_error(x: DataFrame, width: int, found: Components) -> float:
    """Largest entry, in size, of the whitened vectors' covariance minus the identity: one more pass."""
    k = len(found.values)

    def of_rows(rows: np.ndarray) -> np.ndarray:
        w = found.whiten(rows)
        return np.vstack([w.T @ w, w.sum(axis=0)])

    sums = add_up(x, (k + 1, k), of_rows, width) / found.moments.n
    return float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = MOST_COMPONENTS) -> DataFrame:
    """One row for each vector that takes part and each component."""
    spark = vectors.sparkSession
    common.ship(spark)
    x = common.materialize(integers(vectors), "integers")
    length = x.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if length is None:
        return spark.createDataFrame([], OUT)
    width = length["width"]
    x = x.where(F.size("x") == width)
    found = fit(x, width, components)
    k = len(found.values)
    if not k:
        return spark.createDataFrame([], OUT)
    error = identity_error(x, width, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in matrices(batches, width):
            each = np.repeat(np.arange(len(rows)), k)
            size = len(each)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                    pa.array(np.full(size, found.moments.n)),
                    pa.array(found.moments.deviations(rows), pa.int64()).take(pa.array(each)),
                    pa.array(found.whiten(rows).ravel()),
                    pa.array(np.tile(found.explained, len(rows))),
                    pa.array(np.full(size, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return x.mapInArrow(common.tidy(run), OUT)
