"""Operator 11 against a dense eigen-decomposition."""

import numpy as np
import pytest

from lodestrata.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>, x string, n int, component string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "clash", 1, "clash") for i, v in enumerate(vectors)], SCHEMA)


def brute(vectors, most=32):
    x = np.floor(64 * np.array(vectors, float)).astype(object).astype(int) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    centred = (n * x - s) / n
    v = centred.T @ centred / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:most], q[:, ::-1][:, :most]
    keep = e > 1e-12 * max(e[0], 0)
    return n, deviation, centred @ q[:, keep] / np.sqrt(e[keep]), e[keep] / np.trace(v) if np.trace(v) else e[keep]


def same(found, ids, wanted):
    n, deviation, whitened, explained = wanted
    rows = sorted(found, key=lambda r: (r.vec_id, r.component))
    k = whitened.shape[1]
    assert len(rows) == len(ids) * k and {r.n for r in rows} == {n}
    got = np.array([r.whitened for r in rows]).reshape(len(ids), k)
    assert [r.deviation for r in rows[::k]] == deviation
    assert np.allclose(np.abs(got), np.abs(whitened), atol=1e-8)
    assert np.allclose(got.T @ got / n, np.eye(k), atol=1e-8)
    assert np.allclose([r.explained for r in rows[:k]], explained, rtol=1e-9)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-6


def test_query_equals_dense_decomposition(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    same(queries.op11_whitening(spark, sf_dir).collect(), [r.vec_id for r in rows], brute([r.embedding for r in rows]))


def test_more_dimensions_than_a_block(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((300, 90)) * np.linspace(3, 0.5, 90)).tolist()
    same(whitening.whiten(frame(spark, vectors)).collect(), range(300), brute(vectors))


def test_awkward_rows(spark):
    good = [[1.0, 2.0, 0.5], [1.0, 2.0, 0.5], [0.25, -1.0, 3.0], [2.0, 0.0, -1.5], [0.5, 0.5, 0.5]]
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 0.0, 1.0], [float("inf"), 0.0, 1.0], [1.0, 2.0]]
    df = frame(spark, good + bad)
    same(whitening.whiten(df).collect(), range(5), brute(good))
    again = whitening.whiten(df.union(df)).collect()
    assert len(again) == 30 and {r.n for r in again} == {10}
    null_id = frame(spark, good).selectExpr("if(vec_id = 3, null, vec_id) AS vec_id", "embedding")
    assert sum(r.vec_id is None for r in whitening.whiten(null_id).collect()) == 3


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 4])
def test_nothing_to_whiten(spark, vectors):
    df = whitening.whiten(frame(spark, vectors))
    assert df.count() == 0
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_directions_without_variance_have_no_component(spark):
    vectors = [[float(i), 7.0, 2.0 * i] for i in range(6)]
    found = whitening.whiten(frame(spark, vectors)).collect()
    assert {r.component for r in found} == {1} and abs(found[0].explained - 1) < 1e-12


def test_large_entries_are_exact_or_null():
    held = whitening.Moments(3, [3 * (1 << 30), 1])
    x = np.array([[1 << 30, 0], [(1 << 30) + 9, 1], [0, 0]], np.int64)
    wanted = [sum((3 * int(a) - s) ** 2 for a, s in zip(row, [3 * (1 << 30), 1], strict=True)) for row in x]
    assert held.deviations(x) == [w if w <= whitening.LONG_MAX else None for w in wanted]
    huge = whitening.Moments(1 << 30, [0, 0])
    assert huge.deviations(np.array([[1 << 20, 0], [1, 0]], np.int64)) == [None, 1 << 60]


@pytest.mark.parametrize("values", [[5.0] * 20 + [4.0] * 30 + [1.0] * 150, [9.0] + [0.0] * 99, list(np.linspace(1, 100, 180)), [3.0] * 64])
def test_lanczos_with_equal_and_missing_directions(values):
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    a = q @ np.diag(values) @ q.T
    found, vectors, passes = whitening.lanczos(lambda b: a @ b, len(values), 32)
    assert np.allclose(found, sorted(values, reverse=True)[:32], atol=1e-9)
    assert np.allclose(vectors.T @ vectors, np.eye(len(found)), atol=1e-10)
    assert np.allclose(a @ vectors, vectors * found, atol=1e-9)
    assert passes <= -(-len(values) // 40) + 1
