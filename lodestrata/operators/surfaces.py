"""Surfaces through points: polynomials by summed products, and the convex hull as a mask."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shipping import ship


def terms(x: Column, y: Column, degree: int) -> list[Column]:
    """1, x, y, x x, x y, y y, ... up to ``degree``."""
    power = lambda v, k: F.pow(v, F.lit(k)) if k else F.lit(1.0)
    return [power(x, n - k) * power(y, k) for n in range(degree + 1) for k in range(n + 1)]


def polynomials(points: DataFrame, degree: int = 2) -> DataFrame:
    """key, n, c: least-squares coefficients of ``terms`` for each key, from rows of key, x, y, z.

    One pass adds up the products about each key's own middle and width, a fixed number of sums a key whatever its
    size; they are solved once a key. Rows with a null take no part; of keys with too few points the least coefficients stand.
    """
    ship(points.sparkSession)
    own = points.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    middle = own.groupBy("key").agg(*[F.avg(c).alias(f"m{c}") for c in "xy"], *[F.greatest(F.max(c) - F.min(c), F.lit(1e-12)).alias(f"w{c}") for c in "xy"])
    scaled = own.join(middle, "key").select("key", "z", *[((F.col(c) - F.col(f"m{c}")) / F.col(f"w{c}")).alias(c) for c in "xy"], "mx", "my", "wx", "wy")
    t = terms(F.col("x"), F.col("y"), degree)
    k = len(t)
    b = [F.get("b", F.lit(i)) for i in range(k)]
    sums = scaled.withColumn("b", F.array(*t)).groupBy("key", "mx", "my", "wx", "wy").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(b[i] * b[j]).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(b[i] * F.col("z")).alias(f"q{i}") for i in range(k)]
    )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                p = np.array([[row[f"p{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
                out.append(np.linalg.lstsq(p, np.array([row[f"q{i}"] for i in range(k)]), rcond=1e-12)[0].tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "n", "mx", "my", "wx", "wy")), pa.array(out, pa.list_(pa.float64()))], ["key", "n", "mx", "my", "wx", "wy", "c"])

    kind = points.schema["key"].dataType.simpleString()
    return sums.mapInArrow(solve, f"key {kind}, n long, mx double, my double, wx double, wy double, c array<double>")


def heights(targets: DataFrame, fitted: DataFrame, degree: int = 2) -> DataFrame:
    """``targets`` (key, x, y, ...) with the fitted z; null for a key without a surface."""
    at = targets.join(fitted, "key", "left")
    t = terms((F.col("x") - F.col("mx")) / F.col("wx"), (F.col("y") - F.col("my")) / F.col("wy"), degree)
    z = sum((F.get("c", F.lit(i)) * v for i, v in enumerate(t)), F.lit(0.0))
    return at.select(*targets.columns, z.alias("fitted"))


def hulls(points: DataFrame) -> DataFrame:
    """key, hull (array of x, y against the clock): each task keeps the corners of what it has seen, and the corners' hull is the whole's."""
    ship(points.sparkSession)
    cross = lambda a, b: a[0] * b[1] - a[1] * b[0]

    def corners(xy: np.ndarray) -> np.ndarray:
        xy = np.unique(xy, axis=0)
        if len(xy) < 3:
            return xy
        out = []
        for order in (xy, xy[::-1]):
            chain: list[np.ndarray] = []
            for p in order:
                while len(chain) > 1 and cross(chain[-1] - chain[-2], p - chain[-1]) <= 0:
                    chain.pop()
                chain.append(p)
            out += chain[:-1]
        return np.array(out)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            keys = batch.column("key").to_pylist()
            xy = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in "xy"])
            rows: dict = {}
            for i, key in enumerate(keys):
                rows.setdefault(key, []).append(i)
            for key, at in rows.items():
                own = xy[at]
                held[key] = corners(np.vstack([held[key], own]) if key in held else own)
        keys = [k for k, c in held.items() for _ in c]
        flat = np.vstack(list(held.values())) if held else np.zeros((0, 2))
        yield pa.RecordBatch.from_arrays([pa.array(keys, batch_key), pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["key", "x", "y"])

    def whole(table: pa.Table) -> pa.Table:
        """One key's corners from all tasks."""
        found = corners(np.column_stack([table.column("x").to_numpy(), table.column("y").to_numpy()]))
        kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
        return pa.table({"key": table.column("key").slice(0, 1), "hull": pa.array([[{"x": x, "y": y} for x, y in found.tolist()]], kind)})

    own = points.select("key", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    simple = own.schema["key"].dataType.simpleString()
    batch_key = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[simple]
    return own.mapInArrow(some, f"key {simple}, x double, y double").groupBy("key").applyInArrow(whole, f"key {simple}, hull array<struct<x:double,y:double>>")


def within_hull(x: Column, y: Column, hull: Column, slack: float = 1e-9) -> Column:
    """Whether the point lies in the hull or on its edge; a hull of fewer than three corners holds nothing."""
    after = F.concat(F.slice(hull, 2, F.greatest(F.size(hull) - 1, F.lit(0))), F.slice(hull, 1, 1))
    left = F.zip_with(hull, after, lambda a, b: (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"]) >= -slack)
    return (F.size(hull) >= 3) & F.forall(left, lambda v: v)
