"""Polynomials against a dense fit, hulls against every line through two points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import surfaces


def test_polynomials_equal_a_dense_fit(spark):
    rng = np.random.default_rng(1)
    rows = []
    for key in ("a", "b"):
        x, y = rng.uniform(-130, -129, 400), rng.uniform(45, 46, 400)
        rows += [(key, float(u), float(v), float(np.sin(3 * u) + v * u + rng.standard_normal())) for u, v in zip(x, y, strict=True)]
    rows += [("few", 1.0, 2.0, 5.0), ("a", None, 1.0, 1.0), ("a", 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "key string, x double, y double, z double").repartition(5)
    for degree in (1, 2, 3):
        found = surfaces.heights(df.where("z IS NOT NULL AND x IS NOT NULL"), surfaces.polynomials(df, degree), degree).collect()
        for key in ("a", "b"):
            own = np.array([r[1:] for r in rows if r[0] == key and None not in r])
            u, v = own[:, 0] - own[:, 0].mean(), own[:, 1] - own[:, 1].mean()
            design = np.column_stack([u ** (n - k) * v**k for n in range(degree + 1) for k in range(n + 1)])
            wanted = design @ np.linalg.lstsq(design, own[:, 2], rcond=None)[0]
            got = {(r.x, r.y): r.fitted for r in found if r.key == key}
            assert np.allclose([got[x, y] for x, y, _ in own.tolist()], wanted, atol=1e-7)
        assert [r.fitted for r in found if r.key == "few"] == [pytest.approx(5.0)]


def test_hulls_equal_a_test_of_every_line(spark):
    rng = np.random.default_rng(2)
    cloud = {k: rng.integers(0, 9, (n, 2)).astype(float).tolist() for k, n in ((1, 30), (2, 5), (3, 2), (4, 1))} | {5: [[float(i), 2.0 * i] for i in range(6)]}
    df = spark.createDataFrame([(k, *p) for k, ps in cloud.items() for p in ps], "key long, x double, y double").repartition(4)
    grid = spark.createDataFrame([(k, float(x), float(y)) for k in (*cloud, 9) for x in range(-1, 10) for y in range(-1, 12)], "key long, x double, y double")
    found = {(r.key, r.x, r.y): r.inside for r in grid.join(surfaces.hulls(df), "key", "left").select("key", "x", "y", F.coalesce(surfaces.within_hull(F.col("x"), F.col("y"), F.col("hull")), F.lit(False)).alias("inside")).collect()}

    def inside(points, x, y):
        points = [tuple(p) for p in points]
        sides = [(b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) for a in points for b in points for c in points]
        if not any(sides):
            return False  # on one line
        for a in points:
            for b in points:
                left = [(b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) for p in points]
                if a != b and min(left) >= 0 and (b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) < 0:
                    return False
        return True

    for k, x, y in found:
        assert found[k, x, y] == (k in cloud and inside(cloud[k], x, y)), (k, x, y)
