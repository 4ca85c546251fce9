"""Rasters in tiles: whole numbers, first differences along rows, variable lengths, gzip; a reader opens single tiles."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shipping import ship

CELLS = 256
MISSING = -(1 << 62)


def encode(values: np.ndarray) -> bytes:
    """A grid of whole numbers: each row's first value and differences, sign in the last bit, seven bits a byte, gzip."""
    steps = np.diff(values.astype(np.int64), axis=1, prepend=0).ravel()
    left = ((steps << 1) ^ (steps >> 63)).astype(np.uint64)
    parts, more = [], np.ones(len(left), bool)
    while more.any():
        rest = left >> np.uint64(7)
        again = more & (rest > 0)
        parts.append(np.where(more, (left & np.uint64(127)) | (again.astype(np.uint64) << np.uint64(7)), 256).astype(np.int16))
        left, more = rest, again
    flat = np.stack(parts, axis=1).ravel()
    return gzip.compress(flat[flat < 256].astype(np.uint8).tobytes(), mtime=0)


def decode(data: bytes, rows: int, columns: int) -> np.ndarray:
    raw = np.frombuffer(gzip.decompress(data), np.uint8).astype(np.uint64)
    first = np.flatnonzero(np.append(True, raw[:-1] < 128)) if len(raw) else np.zeros(0, int)
    if len(first) != rows * columns:
        raise ValueError("damaged tile")
    place = np.arange(len(raw)) - np.repeat(first, np.diff(np.append(first, len(raw))))
    left = np.add.reduceat((raw & np.uint64(127)) << (np.uint64(7) * place.astype(np.uint64)), first) if len(raw) else raw
    steps = (left >> np.uint64(1)).astype(np.int64) ^ -(left & np.uint64(1)).astype(np.int64)
    return np.cumsum(steps.reshape(rows, columns), axis=1)


def tiles(cells: DataFrame, offset: float, scale: float, size: int = CELLS) -> DataFrame:
    """tx, ty, data of rows x, y, z: z as round((z - offset) * scale); cells without a value are told apart. At most size x size cells a tile."""
    ship(cells.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        grid = np.full((size, size), MISSING, np.int64)
        grid[table.column("y").to_numpy() % size, table.column("x").to_numpy() % size] = table.column("q").to_numpy()
        held = grid != MISSING
        # Where nothing is known the last value stands, so that the differences stay small; a mask tells the two apart.
        last = np.maximum.accumulate(np.where(held, np.arange(size), 0), axis=1)
        filled = np.where(held[np.arange(size)[:, None], last], np.take_along_axis(grid, last, axis=1), 0)
        mask = gzip.compress(np.packbits(held).tobytes(), mtime=0)
        data = len(mask).to_bytes(4, "big") + mask + encode(filled)
        return pa.table({"tx": table.column("tx").slice(0, 1), "ty": table.column("ty").slice(0, 1), "data": pa.array([data], pa.binary())})

    q = F.round((F.col("z") - offset) * scale).cast("long")
    own = cells.where("z IS NOT NULL").select("x", "y", q.alias("q"), F.floor(F.col("x") / size).alias("tx"), F.floor(F.col("y") / size).alias("ty"))
    return own.groupBy("tx", "ty").applyInArrow(run, "tx long, ty long, data binary")


def cells_of(held: DataFrame, offset: float, scale: float, size: int = CELLS) -> DataFrame:
    """x, y, z of tiles; a filter on tx and ty opens only these tiles."""
    ship(held.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tx, ty, data in zip(*(batch.column(c).to_pylist() for c in ("tx", "ty", "data")), strict=True):
                n = int.from_bytes(data[:4], "big")
                mask = np.unpackbits(np.frombuffer(gzip.decompress(data[4 : 4 + n]), np.uint8), count=size * size).astype(bool).reshape(size, size)
                y, x = np.nonzero(mask)
                z = decode(data[4 + n :], size, size)[y, x] / scale + offset
                yield pa.RecordBatch.from_arrays([pa.array(x + tx * size, pa.int64()), pa.array(y + ty * size, pa.int64()), pa.array(z)], ["x", "y", "z"])

    return held.mapInArrow(run, "x long, y long, z double")


def gzip_lines(df: DataFrame, path: str) -> None:
    """Rows as gzip JSON lines, keys sorted and nulls left out."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.option("compression", "gzip").text(path)
