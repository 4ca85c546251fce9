"""Skeletons of rasters by thinning over tiles, and graphs without their short dead ends.

A tile is thinned with a border of its neighbours' cells. A step of thinning looks one cell far, so
a border of ``HALO`` cells allows that many steps before tiles have to exchange borders again; the
result is that of thinning the whole raster at once. Cells travel and are thinned as words of 64.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize
from ..sources.shipping import ship
from .components import connected_components

TILE = 256
HALO = 16


def thin_once(a: np.ndarray, second: bool) -> np.ndarray:
    """One of the two alternating steps of the public thinning rule, on cells inside a border of one."""
    # The eight neighbours in a circle, north first.
    p = [a[:-2, 1:-1], a[:-2, 2:], a[1:-1, 2:], a[2:, 2:], a[2:, 1:-1], a[2:, :-2], a[1:-1, :-2], a[:-2, :-2]]
    count = sum(x.astype(np.int8) for x in p)
    turns = sum((~x & y).astype(np.int8) for x, y in zip(p, [*p[1:], p[0]], strict=True))
    north, east, south, west = p[0], p[2], p[4], p[6]
    open_ = ~(north & east & west) & ~(north & south & west) if second else ~(north & east & south) & ~(east & south & west)
    out = a.copy()
    out[1:-1, 1:-1] &= ~((count >= 2) & (count <= 6) & (turns == 1) & open_)
    return out


def thin_words(a: np.ndarray, second: bool) -> np.ndarray:
    """``thin_once`` on packed cells: a[w, x] holds the 64 cells y = 64 w + bit of a column."""

    def beside(v: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(v)
        if by > 0:
            out[:, :-1] = v[:, 1:]
        else:
            out[:, 1:] = v[:, :-1]
        return out

    def two_of(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        one, two = np.zeros_like(a), np.zeros_like(a)
        for v in found:
            two |= one & v
            one |= v
        return one, two

    north, south = a << np.uint64(1), a >> np.uint64(1)
    north[1:] |= a[:-1] >> np.uint64(63)
    south[:-1] |= a[1:] << np.uint64(63)
    east, west = beside(a, 1), beside(a, -1)
    p = [north, beside(north, 1), east, beside(south, 1), south, beside(south, -1), west, beside(north, -1)]
    turned, again = two_of([~x & y for x, y in zip(p, [*p[1:], p[0]], strict=True)])
    open_ = ~(north & east & west) & ~(north & south & west) if second else ~(north & east & south) & ~(east & south & west)
    return a & ~(two_of(p)[1] & two_of([~x for x in p])[1] & turned & ~again & open_)


def packed(cells: DataFrame) -> DataFrame:
    """x, w, m: the cells of a column from y = 64 w on as the bits of m, so that a raster is shuffled as words, not cells."""
    own = cells.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    return own.groupBy("x", F.expr("shiftright(y, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(y & 63 AS INT)))").alias("m"))


def unpacked(words: DataFrame) -> DataFrame:
    set_ = F.explode(F.expr("filter(sequence(0, 63), b -> (shiftright(m, b) & 1) = 1)"))
    return words.select("x", "w", set_.alias("b")).select("x", (F.col("w") * 64 + F.col("b")).alias("y"))


def per_tile(words: DataFrame, tile: int, halo: int, work: Callable, schema: str) -> DataFrame:
    """The rows ``work`` makes of each tile: it gets the cells as words with at least ``halo`` cells around the tile, their first
    x and w, and the words that mark the tile's own cells."""
    ship(words.sparkSession)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        tx, ty = table.column("tx")[0].as_py(), table.column("ty")[0].as_py()
        x, w = table.column("x").to_numpy(), table.column("w").to_numpy()
        x0, w0 = int(x.min()) - 1, int(w.min()) - 1
        a = np.zeros((int(w.max()) - w0 + 2, int(x.max()) - x0 + 2), np.uint64)
        np.bitwise_or.at(a, (w - w0, x - x0), table.column("m").to_numpy().view(np.uint64))
        y = (w0 * 64 + np.arange(a.shape[0] * 64)) // tile == ty
        rows = np.packbits(y.reshape(-1, 64), axis=1, bitorder="little").view(np.uint64)
        columns = (x0 + np.arange(a.shape[1])) // tile == tx
        own = np.where(columns[None, :], rows, np.uint64(0))
        return pa.table(dict(zip(names, work(a, x0, w0, own), strict=True)))

    within = lambda low, high: F.explode(F.sequence(F.floor(low / tile), F.floor(high / tile)))
    dealt = words.where("m <> 0").select("x", "w", "m", within(F.col("x") - halo, F.col("x") + halo).alias("tx"))
    dealt = dealt.withColumn("ty", within(F.col("w") * 64 - halo, F.col("w") * 64 + 63 + halo))
    return dealt.groupBy("tx", "ty").applyInArrow(run, schema)


WORDS = "x long, w long, m long, moved boolean"


def _words(a: np.ndarray, x0: int, w0: int, own: np.ndarray, moved: bool) -> list[pa.Array]:
    """The columns of ``WORDS``; a row without cells tells of a tile that moved and is empty now."""
    kept = a & own
    w, x = np.nonzero(kept)
    m = kept[w, x].view(np.int64)
    if moved and not len(m):
        x, w, m = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
    return [pa.array(x + x0, pa.int64()), pa.array(w + w0, pa.int64()), pa.array(m, pa.int64()), pa.array(np.full(len(m), moved))]


def _settled(words: DataFrame, tile: int, halo: int, work: Callable) -> DataFrame:
    """``work`` on all tiles in rounds, until a round's last step changed no tile's own cells."""
    while True:
        words = materialize(per_tile(words, tile, halo, work, WORDS), "words")
        if words.where("moved").isEmpty():
            return words.select("x", "w", "m")


def thinned_words(words: DataFrame, tile: int = TILE, halo: int = HALO) -> DataFrame:
    if halo % 2:
        raise ValueError("the halo must be even")

    def work(a: np.ndarray, x0: int, w0: int, own: np.ndarray) -> list[pa.Array]:
        for _ in range(halo // 2):
            before, a = a, thin_words(thin_words(a, False), True)
            if (a == before).all():
                break
        return _words(a, x0, w0, own, bool(((a ^ before) & own).any()))

    return _settled(words, tile, halo, work)


def thinned(cells: DataFrame, tile: int = TILE, halo: int = HALO) -> DataFrame:
    """x, y of the skeleton of the set of cells (x long, y long); the halo is even, so that rounds begin alike."""
    return unpacked(thinned_words(packed(cells), tile, halo))


#: The eight neighbours, each beside its opposite: straight ones first.
AROUND = ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, -1), (1, -1), (-1, 1))


def _touching(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x and y of the cells inside the window, and for each the places of the cells it touches, -1 where there is none: a
    diagonal counts only where no corner joins the two."""
    bits = np.unpackbits(np.ascontiguousarray(a.T).view(np.uint8), axis=1, bitorder="little").astype(bool)
    x, y = np.nonzero(bits)
    place = np.full((bits.shape[0] + 2, bits.shape[1] + 2), -1, np.int64)
    place[x + 1, y + 1] = np.arange(len(x))
    near = np.stack([place[x + 1 + dx, y + 1 + dy] for dx, dy in AROUND], axis=1)
    for k, (dx, dy) in enumerate(AROUND[4:], 4):
        corner = (place[x + 1 + dx, y + 1] >= 0) | (place[x + 1, y + 1 + dy] >= 0)
        near[corner, k] = -1
    return x, y, near


def _name(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x << 32) | (y & 0xFFFFFFFF)


def pruned_words(words: DataFrame, longest: float, tile: int = TILE, rounds: int = 4) -> DataFrame:
    """``words`` without the cells of the dead ends that ``pruned`` takes from the graph of touching cells.

    A round looks no farther than along two dead ends and a cell beyond, so a halo of that for each allows some rounds at
    once. An end's cells lose all edges with it, and no corner goes without a cell it joined, so the cells left have the edges left.
    """
    reach = int(longest)

    def work(a: np.ndarray, x0: int, w0: int, own: np.ndarray) -> list[pa.Array]:
        x, y, near = _touching(a)
        name = _name(x + x0, y + w0 * 64)
        here = np.unpackbits(np.ascontiguousarray(own.T).view(np.uint8), axis=1, bitorder="little").astype(bool)[x, y]
        left = np.ones(len(x), bool)
        moved = False
        for _ in range(rounds):
            degree = (near >= 0).sum(axis=1)
            leaf = at = np.flatnonzero(degree == 1)
            before, straight, slanted = np.full(len(at), -1), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            trail, found = [at], []
            for _ in range(reach):
                on = (near[at] >= 0) & (near[at] != before[:, None])
                k = on.argmax(axis=1)
                before, at = at, near[at, k]
                straight, slanted = straight + (k < 4), slanted + (k >= 4)
                length = straight + slanted * 2.0**0.5
                ends = (degree[at] > 2) & (length <= longest)
                if ends.any():
                    found.append((at[ends], length[ends], leaf[ends], [t[ends] for t in trail]))
                go = (degree[at] == 2) & (length < longest)
                leaf, at, before, straight, slanted, trail = leaf[go], at[go], before[go], straight[go], slanted[go], [*(t[go] for t in trail), at[go]]
                if not len(at):
                    break
            moved = False
            if not found:
                break
            junction, length, tip = (np.concatenate([f[i] for f in found]) for i in range(3))
            order = np.lexsort((name[tip], length, junction))
            ranked = junction[order]
            rank = np.arange(len(order)) - np.searchsorted(ranked, ranked)
            taken = np.zeros(len(order), bool)
            taken[order] = rank < degree[ranked] - 2
            gone, first = np.zeros(len(x), bool), 0
            for ends, _, _, trails in found:
                mine = taken[first : first + len(ends)]
                first += len(ends)
                for t in trails:
                    gone[t[mine]] = True
            if not gone.any():
                break
            near[gone] = -1
            near[(near >= 0) & gone[near]] = -1
            left &= ~gone
            moved = bool((gone & here).any())
        bits = np.zeros((a.shape[1], a.shape[0] * 64), np.uint8)
        bits[x[left], y[left]] = 1
        kept = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).T
        return _words(kept, x0, w0, own, moved)

    return _settled(words, tile, rounds * (2 * reach + 2), work)


def word_graph(words: DataFrame, tile: int = TILE) -> DataFrame:
    """``cell_graph`` of packed cells."""

    def work(a: np.ndarray, x0: int, w0: int, own: np.ndarray) -> list[pa.Array]:
        x, y, near = _touching(a)
        here = np.unpackbits(np.ascontiguousarray(own.T).view(np.uint8), axis=1, bitorder="little").astype(bool)[x, y]
        name = _name(x + x0, y + w0 * 64)
        # Each edge from one of its cells: the steps (1, 0), (0, 1), (1, 1) and (-1, 1).
        steps = [0, 2, 4, 7]
        own_, k = np.nonzero((near[:, steps] >= 0) & here[:, None])
        return [pa.array(name[own_]), pa.array(name[near[own_, np.array(steps)[k]]]), pa.array(np.where(k < 2, 1.0, 2.0**0.5))]

    return per_tile(words, tile, 1, work, "a long, b long, length double")


def cell_graph(cells: DataFrame) -> DataFrame:
    """Edges a, b (longs), length between touching cells of a skeleton; a diagonal counts only where no corner joins the two."""
    return word_graph(packed(cells))


def pruned(edges: DataFrame, longest: float, rounds: int = 1000) -> DataFrame:
    """``edges`` (a, b: longs, length) without the dead ends of up to ``longest`` that hang on a junction.

    A dead end is a chain from a node of one edge over nodes of two to a node of three or more. In a round a
    junction of k edges gives up at most k - 2 of its dead ends, the shortest first, then the one with the smaller
    end; what is left at a junction that became a passage belongs to a longer chain and is looked at anew.
    """
    current = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "length").distinct(), "graph")
    for _ in range(rounds):
        ends = current.select(F.col("a").alias("node"), F.struct("a", "b").alias("edge"), "length").unionByName(current.select(F.col("b").alias("node"), F.struct("a", "b").alias("edge"), "length"))
        degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
        known = materialize(ends.join(degree, "node").withColumn("id", F.xxhash64("edge.a", "edge.b")), "ends")
        passing = known.where("degree = 2").groupBy("node").agg(F.min("id").alias("a"), F.max("id").alias("b")).select("a", "b")
        chains = connected_components(passing)
        placed = known.join(chains, known["id"] == chains["node"], "left").select(known["node"], "edge", "length", "degree", F.coalesce("component", "id").alias("chain"))
        whole = placed.groupBy("chain").agg(
            (F.sum("length") / 2).alias("length"), F.min(F.when(F.col("degree") == 1, F.col("node"))).alias("leaf"), F.count_if(F.col("degree") == 1).alias("leaves"),
            F.min(F.when(F.col("degree") > 2, F.struct("node", "degree"))).alias("junction"),
        )
        spurs = whole.where((F.col("leaves") == 1) & F.col("junction").isNotNull() & (F.col("length") <= longest))
        # Kept by counts instead of a sorted list: at a junction only as many are kept as would leave it two edges.
        from pyspark.sql import Window

        order = Window.partitionBy("junction.node").orderBy("length", "leaf")
        gone = spurs.withColumn("k", F.row_number().over(order)).where(F.col("k") <= F.col("junction.degree") - 2).select("chain")
        lost = placed.join(gone, "chain", "left_semi").select("edge.a", "edge.b").distinct()
        lost = materialize(lost, "spurs")
        if lost.isEmpty():
            return current
        current = materialize(current.join(lost, ["a", "b"], "left_anti"), "graph")
    raise RuntimeError(f"dead ends were left after {rounds} rounds")
