"""Operator 3: exact top-k inner-product search by Fagin's threshold algorithm.

Components become integers, floor(256 x). Vectors are dealt to blocks of about
``BLOCK`` rows, and every query is dealt to every block. A task reads a block's
vectors, builds its lists once and then answers the queries as they come. Each
dimension has a list sorted by value. A query walks all lists at once from the end
that is best for the sign of its own component, scores every vector it meets in
full, and stops when the bound (its product with the values reached) is below
the k-th best score: no unseen vector can then enter, ties included. The best k
of each block are merged per query.

Defined cases: vectors that are null or hold a null or non-finite component
take no part, nor do rows without an id; shorter vectors count as padded with
zeros; every row is a candidate, so a repeated row counts as often as it stands,
and every row with a query's id is a query of its own with its own ranks; no row
with the query's id is its candidate; equal scores go by id; fewer than k
candidates give fewer rows; an empty table gives none; scores beyond a long are
clipped to its range; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

BLOCK = 8192
SAFE = 1 << 26
LONG = np.iinfo(np.int64)


def as_matrix(vectors: list, width: int, small: bool) -> np.ndarray:
    """Integers floor(256 x), rows padded with zeros; Python integers where 64 bits might not hold a product sum."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    out = np.floor(256.0 * out)
    if small:
        return out.astype(np.int64)
    return np.array([[int(x) for x in row] for row in out], dtype=object).reshape(out.shape)


class Lists:
    """Per-dimension sorted lists over one block."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        order = np.argsort(ids, kind="stable")  # rows by id, so that ties need no further rule
        self.ids, self.matrix = ids[order], matrix[order]
        self.order = np.argsort(self.matrix, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(self.matrix, self.order.T, axis=0).T.copy()

    def top(self, query: np.ndarray, own_id: int, k: int) -> tuple[list, int]:
        """([(score, id)] best first, rows scored)."""
        n = len(self.ids)
        dims = np.flatnonzero(query != 0)
        best_rows, best_scores = np.zeros(0, np.int64), np.zeros(0, self.matrix.dtype)
        seen = np.zeros(n, bool)
        depth, step, scored = 0, 16, 0
        up = query[dims] > 0
        while depth < n:
            end = min(n, depth + step) if len(dims) else n
            if len(dims):
                low = self.order[dims[~up], depth:end].ravel()
                high = self.order[dims[up], n - end : n - depth].ravel()
                met = np.zeros(n, bool)
                met[low] = True
                met[high] = True
                rows = np.flatnonzero(met & ~seen)
            else:
                rows = np.arange(n)
            seen[rows] = True
            rows = rows[self.ids[rows] != own_id]
            scored += len(rows)
            rows = np.concatenate([best_rows, rows])
            scores = np.concatenate([best_scores, self.matrix[rows[len(best_rows) :]] @ query])
            keep = np.lexsort((self.ids[rows], -scores))[:k]
            best_rows, best_scores = rows[keep], scores[keep]
            depth, step = end, step * 2
            if len(best_rows) == k and len(dims):
                bound = query[dims[up]] @ self.values[dims[up], n - depth] + query[dims[~up]] @ self.values[dims[~up], depth - 1]
                if bound < best_scores[-1]:
                    break
        return list(zip(best_scores.tolist(), self.ids[best_rows].tolist(), strict=True)), scored


def search(batches: Iterator[pa.RecordBatch], k: int, width: int, small: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, vectors before queries: one block's vectors are held at a time."""
    block, ids, vectors, lists = None, [], [], None
    for batch in batches:
        blocks = batch.column("block").to_numpy(zero_copy_only=False)
        asks = batch.column("asks").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]) | (asks[1:] != asks[:-1]), [True]]))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = batch.slice(lo, hi - lo)
            if blocks[lo] != block:
                block, ids, vectors, lists = blocks[lo], [], [], None
            if not asks[lo]:
                ids.extend(own.column("vec_id").to_pylist())
                vectors.append(as_matrix(own.column("v").to_pylist(), width, small))
                continue
            if not ids:
                continue
            if lists is None:
                lists = Lists(np.array(ids), np.concatenate(vectors))
                vectors = []
            out: list[tuple[int, int, int, int]] = []
            matrix = as_matrix(own.column("v").to_pylist(), width, small)
            for q, row, vector in zip(own.column("vec_id").to_pylist(), own.column("row").to_pylist(), matrix, strict=True):
                found, _ = lists.top(vector, q, k)
                out.extend((q, row, i, min(max(s, LONG.min), LONG.max)) for s, i in found)
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "row", "vec_id", "score"])


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose id is divisible by ``every`` its k best other rows."""
    common.ship(vectors.sparkSession)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull()
        & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    )
    v = common.materialize(v.withColumn("row", F.monotonically_increasing_id()), "vectors")
    size = F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))
    n, width, largest = v.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(size, F.lit(0.0))).first()
    small = (256.0 * largest + 1) * max(width, 1) ** 0.5 < SAFE
    blocks = max(1, -(-n // BLOCK))
    data = v.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"), F.lit(False).alias("asks"), "vec_id", "row", "v")
    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    queries = v.where(F.col("vec_id") % F.lit(every) == 0).select(every_block, F.lit(True).alias("asks"), "vec_id", "row", "v")
    dealt = data.unionByName(queries).repartitionByRange(blocks, "block").sortWithinPartitions("block", "asks")
    found = dealt.mapInArrow(common.tidy(lambda batches: search(batches, k, width, small)), "query_id long, row long, vec_id long, score long")
    order = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.n, d.vec_id AS vec_id, list_inner_product(q.e, d.e)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id, n ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
