"""The exact join of texts by their sets of word runs against all pairs, whole, in small parts and where nothing is central."""

from __future__ import annotations

import itertools
import random
import time

import numpy as np
import pytest

from lodestrata.operators import alike


def runs_of(text, width):
    w = text.lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def brute(rows, width, percent):
    sets = {i: runs_of(t, width) for i, t in rows}
    shared = {(a, b): (len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a, b in itertools.combinations(sorted(sets), 2)}
    return {(a, b, s, t) for (a, b), (s, t) in shared.items() if 100 * s >= percent * t}


def components(pairs):
    parent = {i: i for p in pairs for i in p[:2]}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b, *_ in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {(i, find(i)) for i in parent}


def family(rng, base, members, most):
    for _ in range(members):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = f"z{rng.random()}"
        yield " ".join(w[: len(w) - rng.randint(0, most)])


def mixed(seed):
    rng = random.Random(seed)
    texts = [t for f in range(3) for t in family(rng, [f"b{f}x{i % 70}" for i in range(60 + 60 * f)], 40, 8)]
    return [(7 * i - 50, t) for i, t in enumerate([*texts, "two words", "Two  words", "a b c d e", ""])]


@pytest.mark.parametrize("parts", [(alike.PART, alike.PART_SETS, alike.CELL), (900, 7, 500)])
def test_all_pairs_and_components_by_brute_force(spark, monkeypatch, parts):
    for name, value in zip(("PART", "PART_SETS", "CELL"), parts, strict=True):
        monkeypatch.setattr(alike, name, value)
    rows = mixed(3)
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    wanted = brute(rows, 5, 80)
    assert len(wanted) > 200
    found = [tuple(r) for r in alike.alike(texts, texts, 5, 80, every=True).collect()]
    assert len(found) == len(set(found)) and set(found) == wanted
    links = {tuple(r) for r in alike.alike(texts, texts, 5, 80, every=False).collect()}
    assert links <= wanted and components(links) == components(wanted)
    if parts[0] == alike.PART:
        return
    given = spark.createDataFrame([(rows[0][0], r[0]) for r in rows[1:50]], "a long, b long")
    assert components({tuple(r) for r in alike.alike(texts, texts, 5, 80, every=False, linked=given).collect()}) == components(wanted)
    longer = {r for r in wanted if min(len(dict(rows)[i].split()) for i in r[:2]) >= 5}
    assert {tuple(r) for r in alike.alike(texts, texts, 5, 80, every=True, short=False).collect()} == longer != wanted
    own = texts.where("doc_id % 2 = 0")
    assert {tuple(r) for r in alike.alike(texts, own, 5, 80, every=True).collect()} == {r for r in wanted if r[0] % 2 == r[1] % 2 == 0}
    assert alike.alike(texts.limit(0), texts, 5, 80, every=True).count() == 0


def test_pairs_of_a_cell_by_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(60):
        base = rng.choice(300, 40, replace=False)
        sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(30, 41), replace=False), rng.integers(300, 900, rng.integers(0, 6))])).astype(np.uint64) for _ in range(20)]
        parts = rng.integers(0, 2, 20) if rng.random() < 0.5 else np.zeros(20, int)
        crossing = len(set(parts.tolist())) > 1
        wanted = set()
        for i, j in itertools.combinations(range(20), 2):
            shared, together = len(np.intersect1d(sets[i], sets[j])), len(np.union1d(sets[i], sets[j]))
            if 10 * shared >= 8 * together and not (crossing and parts[i] == parts[j]):
                wanted.add((i, j, shared, together))
        ordered = lambda found: {(min(i, j), max(i, j), s, t) for i, j, s, t in found.tolist()}
        assert ordered(alike.alike_in_cell(sets, parts, 80, True)) == wanted
        links = ordered(alike.alike_in_cell(sets, parts, 80, False, [(0, 1), (5, 3)]))
        assert links <= wanted and components(links) == components(wanted)


def test_meetings_count_pairs_and_chain_common_hashes():
    rng = np.random.default_rng(9)
    for few in (2, 4, 99):
        held = {3 * i: rng.choice(25, rng.integers(1, 9), replace=False) for i in range(30)}
        size = {i: int(rng.integers(10, 20)) for i in held}
        low, ids = np.concatenate(list(held.values())).astype(np.uint32), np.repeat(list(held), [len(h) for h in held.values()])
        often = np.bincount(low)
        got = alike.meetings(low, ids, np.array([size[i] for i in ids.tolist()]), 80, few)
        rows = list(zip(*(x.tolist() for x in got.values()), strict=True))
        assert all(a < b and (na, nb) == (size[a], size[b]) for a, b, na, nb, _ in rows)
        near = [(a, b) for a, b in itertools.combinations(held, 2) if 5 * min(size[a], size[b]) >= 4 * max(size[a], size[b])]
        shared = {(a, b): [h for h in held[a] if h in held[b]] for a, b in near}
        assert {r[:2]: r[4] for r in rows if r[4] < alike.CHAINED} == {p: n for p, s in shared.items() if (n := sum(often[h] <= few for h in s))}
        of = dict(components([r for r in rows if r[4] >= alike.CHAINED]))
        assert all(of[a] == of[b] for (a, b), s in shared.items() if any(often[h] > few for h in s))
    assert len(alike.meetings(np.zeros(0, np.uint32), *[np.zeros(0, np.int64)] * 2, 80)["a"]) == 0


def test_the_screen_moves_less_than_its_texts(spark, sf_dir):
    """What is shuffled and written stays under the size of the texts; sets of hashes, moved once for each pair, were several times that."""
    import __spark_entry__ as entry

    def moved():
        time.sleep(1)
        sc = spark.sparkContext
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._gateway.jvm.double, 0), None)
        stages = [stages.apply(i) for i in range(stages.size())]
        return {s.stageId(): s.shuffleWriteBytes() + s.outputBytes() for s in stages}

    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(octet_length(text)) AS n").first().n
    before = moved()
    entry.queries()["near_duplicate_screen"](spark, sf_dir).collect()
    bytes_moved = sum(n for i, n in moved().items() if i not in before)
    assert 0 < bytes_moved < texts
