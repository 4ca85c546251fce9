"""Thinning and pruning against whole rasters and a plain sequence of removals; tiles as round trips."""

import numpy as np
import pytest

from lodestrata.operators import skeleton
from lodestrata.sources import tiles


def shape(seed):
    rng = np.random.default_rng(seed)
    a = np.zeros((46, 58), bool)
    for _ in range(5):
        (x0, x1), (y0, y1) = rng.integers(6, 52, 2), rng.integers(6, 40, 2)
        for t in np.linspace(0, 1, 150):
            x, y = int(x0 + t * (x1 - x0)), int(y0 + t * (y1 - y0))
            a[y - 3 : y + 4, x - 3 : x + 4] = True
    return a


def whole(a):
    a = np.pad(a, 1)
    while True:
        b = skeleton.thin_once(skeleton.thin_once(a, False), True)
        if (a == b).all():
            return a[1:-1, 1:-1]
        a = b


@pytest.mark.parametrize(("tile", "halo"), [(16, 4), (256, 16)])
def test_tiles_thin_like_the_whole(spark, tile, halo):
    a = shape(1)
    y, x = np.nonzero(a)
    df = spark.createDataFrame([(int(i) - 40, int(j) - 20) for i, j in zip(x, y, strict=True)], "x long, y long")
    got = {(r.x, r.y) for r in skeleton.thinned(df, tile, halo).collect()}
    y, x = np.nonzero(whole(a))
    assert got == {(int(i) - 40, int(j) - 20) for i, j in zip(x, y, strict=True)} and 30 < len(got) < a.sum() / 3
    assert skeleton.thinned(df.limit(0)).count() == 0


def sequence(edges, longest):
    """One dead end at a time in rounds: the shortest of each junction, while it keeps two edges."""
    edges = {(min(a, b), max(a, b)): w for a, b, w in edges if a != b}
    while True:
        near = {}
        for (a, b), w in edges.items():
            near.setdefault(a, {})[b] = w
            near.setdefault(b, {})[a] = w
        found = {}
        for leaf in [n for n in near if len(near[n]) == 1]:
            chain, before, at, length = [], None, leaf, 0.0
            while True:
                on = [n for n in near[at] if n != before]
                if (at != leaf and len(near[at]) != 2) or not on:
                    break
                chain.append((min(at, on[0]), max(at, on[0])))
                length += near[at][on[0]]
                before, at = at, on[0]
            if len(near[at]) > 2 and length <= longest:
                found.setdefault(at, []).append((length, leaf, chain))
        gone = {e for junction, spurs in found.items() for _, _, chain in sorted(spurs)[: len(near[junction]) - 2] for e in chain}
        if not gone:
            return set(edges)
        edges = {e: w for e, w in edges.items() if e not in gone}


def test_dead_ends_go_in_rounds(spark):
    rng = np.random.default_rng(4)
    tree = [(i, int(rng.integers(max(0, i - 6), i)), float(rng.integers(1, 9))) for i in range(1, 45)] + [(5, 40, 3.0), (100, 101, 1.0), (101, 102, 1.0), (102, 100, 1.0), (200, 201, 1.0)]
    df = spark.createDataFrame(tree, "a long, b long, length double")
    for longest in (0.5, 12.0):
        assert {(r.a, r.b) for r in skeleton.pruned(df, longest).collect()} == sequence(tree, longest)


def test_touching_cells_make_a_graph(spark):
    cells = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (2, 2), (1, 1), (-5, -5)], "x long, y long")
    found = sorted((r.length) for r in skeleton.cell_graph(cells).collect())
    # (0,0)-(1,1) and (1,0)-(2,1) and (1,1)-(2,2) run around corners that are cells themselves.
    assert found == [1.0, 1.0, 1.0, 1.0]


def test_tiles_round_trip(spark):
    rng = np.random.default_rng(6)
    for grid in (rng.integers(-5, 6, (7, 9)).cumsum(axis=1), rng.integers(-(1 << 40), 1 << 40, (3, 4)), np.zeros((2, 2), int)):
        assert (tiles.decode(tiles.encode(grid), *grid.shape) == grid).all()
    with pytest.raises(ValueError):
        tiles.decode(tiles.encode(np.zeros((2, 2), int)), 3, 3)
    rows = [(int(x), int(y), float(rng.integers(-4000, 0)) / 10) for x, y in {tuple(p) for p in rng.integers(-30, 60, (900, 2)).tolist()}]
    df = spark.createDataFrame([*rows, (500, 500, None)], "x long, y long, z double")
    held = tiles.tiles(df, -1000.0, 10.0, 16)
    assert sorted((r.x, r.y, round(r.z, 6)) for r in tiles.cells_of(held, -1000.0, 10.0, 16).collect()) == sorted(rows)
    one = tiles.cells_of(held.where("tx = 0 AND ty = -1"), -1000.0, 10.0, 16)
    assert sorted((r.x, r.y) for r in one.collect()) == sorted((x, y) for x, y, _ in rows if 0 <= x < 16 and -16 <= y < 0)
    assert tiles.tiles(df.limit(0), 0.0, 1.0).count() == 0


def test_gzip_lines(spark, tmp_path):
    tiles.gzip_lines(spark.createDataFrame([(1, None, "x")], "b int, a string, c string"), str(tmp_path / "l"))
    assert [r.value for r in spark.read.text(str(tmp_path / "l")).collect()] == ['{"b":1,"c":"x"}']
    assert {p.suffix for p in (tmp_path / "l").glob("part-*")} == {".gz"}


def test_the_query_equals_the_whole_raster(spark, sf_dir):
    from lodestrata.plans import QUERIES
    from lodestrata.plans import rasters as plan

    cells = {(r.x, r.y) for r in plan.strokes(spark, sf_dir).collect()}
    low = min(x for x, _ in cells), min(y for _, y in cells)
    a = np.zeros((max(y for _, y in cells) - low[1] + 1, max(x for x, _ in cells) - low[0] + 1), bool)
    for x, y in cells:
        a[y - low[1], x - low[0]] = True
    y, x = np.nonzero(whole(a))
    left = {(int(i) + low[0], int(j) + low[1]) for i, j in zip(x, y, strict=True)}
    name = lambda c: (c[0] << 32) | (c[1] & 0xFFFFFFFF)
    edges = []
    for cx, cy in left:
        for dx, dy in ((1, 0), (0, 1), (1, 1), (-1, 1)):
            if (cx + dx, cy + dy) in left and not (dx and dy and ((cx + dx, cy) in left or (cx, cy + dy) in left)):
                edges.append((name((cx, cy)), name((cx + dx, cy + dy)), (dx * dx + dy * dy) ** 0.5))
    assert {(r.a, r.b) for r in QUERIES["skeleton_lines"](spark, sf_dir).collect()} == sequence(edges, 8.0)


def test_packed_words_thin_and_prune_like_cells(spark):
    a = shape(3)
    a[4:30:3, 20] = True
    for second in (False, True):
        bits = np.pad(a, ((0, 128 - len(a)), (0, 0)))
        words = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64).T
        got = np.unpackbits(np.ascontiguousarray(skeleton.thin_words(words, second).T).view(np.uint8), axis=1, bitorder="little").T.astype(bool)
        assert (got == skeleton.thin_once(np.pad(bits, 1), second)[1:-1, 1:-1]).all()
    y, x = np.nonzero(a)
    df = spark.createDataFrame([(int(i) - 40, int(j) - 20) for i, j in zip(x, y, strict=True)], "x long, y long")
    words = skeleton.packed(df.unionByName(df))
    # A raster travels as words: as many rows as columns have words, however many cells they hold and however often.
    assert words.count() == len({(i, (j - 20) // 64) for i, j in zip(x, y, strict=True)}) < len(x) / 4
    thin = skeleton.thinned_words(words, 16, 4)
    edges = [tuple(r) for r in skeleton.cell_graph(skeleton.unpacked(thin)).collect()]
    for longest in (3.0, 8.0):
        wanted = sequence(edges, longest)
        assert len(wanted) < len(edges)
        for tile, rounds in ((16, 1), (64, 3)):
            left = skeleton.word_graph(skeleton.pruned_words(thin, longest, tile, rounds), tile).collect()
            assert {(min(r.a, r.b), max(r.a, r.b)) for r in left} == wanted and len(left) == len(wanted)
