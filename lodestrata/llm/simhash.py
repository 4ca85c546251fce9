"""Operator 2: SimHash near-duplicates through the general pigeonhole principle.

Fingerprints are reduced to distinct values first, so copies cost one row. The
64 bits are dealt to ``m`` partitions so that correlated bits share one. For
partition thresholds t_1..t_m (each -1 or more) that sum to ``tau - m + 1``,
two fingerprints within ``tau`` bits agree within t_i bits on some partition i.
Each fingerprint gets its own thresholds: a dynamic programme over the
partitions minimises estimated candidates plus probes, the estimates coming
from exact distance histograms of half partitions. Every fingerprint is
indexed once per partition and probes the keys within its threshold; index
rows and probes that share a key are verified on all 64 bits.

Rows of one key come to Python sorted, index rows first, in Arrow batches.
A breadth-first search over the verified links of a key's index rows emits one
edge per fingerprint reached; probes then pass batch by batch, with one edge to
each component of index rows they touch. Output so stays linear in the rows, no
link between components is lost, and memory holds a key's index rows only. A key
with more than ``HOT`` index rows is split first: its rows are dealt again by
``tau + 1`` pieces of the bits outside the key, one of which any two rows within
``tau`` bits have in common. Edges then go to connected components.

Defined cases: a null, empty or blank text has fingerprint zero and links like
any other; very long texts are hashed whole, 65536 shingles at a time; a bit set
in exactly half the hashes is 0; ids may repeat (each row is returned) or be null
(a null id is never a component's smallest id, and a component of null ids only
has a null id); an empty table gives no rows; other columns are ignored, whatever
their names and types.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from ..operators.components import connected_components

BITS = 64
SHINGLE = 4
SEED = 42
SMALL_RUN = 6
HOT = 4096
BROADCAST_ROWS = 1_000_000
SLICE_BYTES = 8 << 20


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles of ``text``."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    hashes = np.fromiter(
        [digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64, n
    )
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half the 64-bit hashes have set."""
    counts = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[lo : lo + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i, c in enumerate(counts.tolist()) if 2 * c > len(hashes))


def fingerprints(docs: DataFrame, width: int = SHINGLE, row: Column | None = None) -> DataFrame:
    """doc_id long, row long (the column given, or null), fp long (the fingerprint's bits as a signed long)."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in common.slices(whole, SLICE_BYTES)):
            fps = np.array([fingerprint(t, width) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(fps.view(np.int64))], ["doc_id", "row", "fp"])

    own = F.lit(None).cast("long") if row is None else row.cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), own.alias("row"), "text").mapInArrow(common.tidy(run), "doc_id long, row long, fp long")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)


def bit_pair_counts(classes: DataFrame) -> tuple[np.ndarray, int]:
    """64 x 64 counts of both bits set over all fingerprints, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for fps in _rows(batches):
            bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(fps)
        cells = np.concatenate([total.ravel(), [n]]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], ["cell", "n"])

    found = classes.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1, np.int64)
    for r in found:
        flat[r["cell"]] = r["n"]
    return flat[:-1].reshape(BITS, BITS), int(flat[-1])


def group_bits(pairs: np.ndarray, n: int, m: int) -> list[list[int]]:
    """Deal the bits to ``m`` partitions of near-equal width, correlated bits together."""
    p = np.diag(pairs) / max(n, 1)
    cov = pairs / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, out = set(range(BITS)), []
    for k in range(m):
        width = BITS // m + (k < BITS % m)
        rest = sorted(free)
        group = [max(rest, key=lambda b: (corr[b, rest].max(), -b))]
        while len(group) < width:
            rest = sorted(free - set(group))
            group.append(max(rest, key=lambda b: (corr[b, group].mean(), -b)))
        free -= set(group)
        out.append(sorted(group))
    return out


def _extract(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    key = np.zeros(len(fps), np.uint64)
    for j, b in enumerate(bits):
        key |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(j)
    return key


@lru_cache(maxsize=64)
def ball(width: int, radius: int) -> np.ndarray:
    """Masks of ``width`` bits with 1 to ``radius`` bits set."""
    return np.array([sum(1 << b for b in c) for r in range(1, radius + 1) for c in combinations(range(width), r)], np.uint64)


def _ball_sizes(width: int, most: int) -> np.ndarray:
    from math import comb

    return np.array([0.0] + list(np.cumsum([comb(width, r) for r in range(most + 1)])))


def halves(parts: list[list[int]]) -> list[tuple[list[int], ...]]:
    """Each partition in sub-partitions of at most 11 bits, whose value counts stay small."""
    return [tuple(x.tolist() for x in np.array_split(np.array(p), -(-len(p) // 11))) for p in parts]


def half_histograms(classes: DataFrame, parts: list[list[int]]) -> list[list[np.ndarray]]:
    """Exact counts of every value of every half partition."""
    subs = [(i, j, bits) for i, h in enumerate(halves(parts)) for j, bits in enumerate(h)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(1 << len(b), np.int64) for _, _, b in subs]
        for fps in _rows(batches):
            for c, (_, _, b) in zip(counts, subs, strict=True):
                c += np.bincount(_extract(fps, b).astype(np.int64), minlength=len(c))
        flat = np.concatenate(counts)
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at])], ["cell", "n"])

    found = classes.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(sum(1 << len(b) for _, _, b in subs), np.int64)
    for r in found:
        flat[r["cell"]] = r["n"]
    out: list[list[np.ndarray]] = [[] for _ in parts]
    at = 0
    for i, _, b in subs:
        out[i].append(flat[at : at + (1 << len(b))])
        at += 1 << len(b)
    return out


def distance_tables(histograms: list[list[np.ndarray]], most: int) -> list[list[np.ndarray]]:
    """For each half and value: the share of fingerprints at distance 0..most from it."""
    tables = []
    for part in histograms:
        row = []
        for h in part:
            values = np.arange(len(h), dtype=np.uint16)
            total = max(h.sum(), 1)
            t = np.zeros((len(h), most + 1))
            for lo in range(0, len(h), 256):
                d = np.bitwise_count(values[lo : lo + 256, None] ^ values[None, :])
                for e in range(most + 1):
                    t[lo : lo + 256, e] = (d == e) @ h / total
            row.append(t)
        tables.append(row)
    return tables


def allocate(fps: np.ndarray, parts: list[list[int]], tables: list[list[np.ndarray]], n: int, tau: int) -> np.ndarray:
    """Thresholds (rows: fingerprints, columns: partitions) of least estimated cost that sum to tau - m + 1."""
    m, most = len(parts), tables[0][0].shape[1] - 1
    options = most + 2  # thresholds -1..most
    costs = []
    for bits, row, split in zip(parts, tables, halves(parts), strict=True):
        dist = None
        for sub, t in zip(split, row, strict=True):
            own = t[_extract(fps, sub).astype(np.int64)]
            if dist is None:
                dist = own
            else:
                joint = np.zeros_like(own)
                for e in range(most + 1):
                    joint[:, e] = (dist[:, : e + 1] * own[:, e::-1][:, : e + 1]).sum(axis=1)
                dist = joint
        candidates = np.concatenate([np.zeros((len(fps), 1)), np.cumsum(dist, axis=1) * n], axis=1)
        costs.append(candidates + _ball_sizes(len(bits), most)[None, :])
    budgets = tau - m + 1 + m  # sum of (t_i + 1)
    best = np.full((len(fps), budgets + 1), np.inf)
    best[:, 0] = 0
    choices = []
    for c in costs:
        new = np.full_like(best, np.inf)
        pick = np.zeros(best.shape, np.int8)
        for s in range(budgets + 1):
            for o in range(min(options - 1, s) + 1):
                v = best[:, s - o] + c[:, o]
                better = v < new[:, s]
                new[better, s] = v[better]
                pick[better, s] = o
        best = new
        choices.append(pick)
    out = np.zeros((len(fps), m), np.int8)
    left = np.full(len(fps), budgets)
    rows = np.arange(len(fps))
    for i in range(m - 1, -1, -1):
        o = choices[i][rows, left]
        out[:, i] = o - 1
        left = left - o
    return out


def choose_partitions(n: int, tau: int) -> int:
    """The number of partitions with the least expected probes and candidates per fingerprint."""
    from math import comb

    def cost(m: int) -> float:
        width = BITS // m
        extra, rest = divmod(tau - m + 1, m)
        total = 0.0
        for i in range(m):
            t = extra + (i < rest)
            size = sum(comb(width, r) for r in range(t + 1)) if t >= 0 else 0
            total += size * (1 + n / 2.0**width)
        return total

    return min(range(2, tau + 2), key=cost)


def index_keys(classes: DataFrame, parts: list[list[int]]) -> DataFrame:
    """The key of each fingerprint in each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fps in _rows(batches):
            keys = np.concatenate([_extract(fps, bits) | np.uint64(i << 58) for i, bits in enumerate(parts)])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])

    return classes.select("fp").mapInArrow(run, "key long")


def probe_rows(classes: DataFrame, parts: list[list[int]], tables: list[list[np.ndarray]], n: int, tau: int) -> DataFrame:
    """key long, fp long, is_index boolean: one index row a partition, and the probes of each fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _rows(batches):
            for lo in range(0, len(whole), 2048):
                fps = whole[lo : lo + 2048]
                thresholds = allocate(fps, parts, tables, n, tau)
                keys, owners, index = [], [], []
                for i, bits in enumerate(parts):
                    top = np.uint64(i << 58)
                    # A partition of 64/2 bits at most fits below the partition number.
                    base = _extract(fps, bits) | top
                    keys.append(base)
                    owners.append(fps)
                    index.append(np.ones(len(fps), bool))
                    for t in range(1, int(thresholds[:, i].max(initial=0)) + 1):
                        who = np.flatnonzero(thresholds[:, i] == t)
                        masks = ball(len(bits), t)
                        keys.append((base[who, None] ^ masks[None, :]).ravel())
                        owners.append(np.repeat(fps[who], len(masks)))
                        index.append(np.zeros(len(who) * len(masks), bool))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners).view(np.int64)), pa.array(np.concatenate(index))],
                    ["key", "fp", "is_index"],
                )

    return classes.select("fp").mapInArrow(run, "key long, fp long, is_index boolean")


def split_rows(hot: DataFrame, parts: list[list[int]], tau: int) -> DataFrame:
    """Rows of hot keys, dealt again by pieces of the bits outside their key's partition."""
    pieces = []
    for bits in parts:
        rest = np.array(sorted(set(range(BITS)) - set(bits)))
        pieces.append([x.tolist() for x in np.array_split(rest, tau + 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1 << 16):
                own = batch.slice(lo, 1 << 16)
                key = own.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
                fps = own.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
                index = own.column("is_index").to_numpy(zero_copy_only=False)
                for i in np.unique(key >> np.uint64(58)).tolist():
                    at = key >> np.uint64(58) == i
                    for j, bits in enumerate(pieces[i]):
                        value = (key[at] + np.uint64(j)) * np.uint64(0x9E3779B97F4A7C15) ^ _extract(fps[at], bits)
                        value = (value ^ (value >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
                        yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(fps[at].view(np.int64)), pa.array(index[at])], ["key", "fp", "is_index"])

    return hot.select("key", "fp", "is_index").mapInArrow(run, "key long, fp long, is_index boolean")


def _spread(fps: np.ndarray, tau: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """A component number for each of the distinct ``fps``, and the spanning edges of their links."""
    label = np.full(len(fps), -1)
    edges, component = [], 0
    rest = np.arange(len(fps))
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        label[frontier[0]] = component
        while frontier and len(rest):
            f = frontier.pop()
            near = np.bitwise_count(fps[rest] ^ fps[f]) <= tau
            if near.any():
                found = rest[near]
                label[found] = component
                edges.append((np.full(len(found), fps[f]), fps[found]))
                frontier.extend(found.tolist())
                rest = rest[~near]
        component += 1
    return label, edges


class _Key:
    """The rows of one key as they come: index rows first, then probes."""

    def __init__(self, tau: int):
        self.tau = tau
        self.parts: list[np.ndarray] = []
        self.index: np.ndarray | None = None

    def add(self, fps: np.ndarray, is_index: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Verified edges that these rows bring."""
        self.parts.append(fps[is_index])
        probes = np.unique(fps[~is_index])
        if len(probes):
            yield from self.close()
        if not len(probes) or not len(self.index):
            return
        step = max(1, (1 << 21) // len(self.index))
        for lo in range(0, len(probes), step):
            own = probes[lo : lo + step]
            r, c = np.nonzero(np.bitwise_count(own[:, None] ^ self.index[None, :]) <= self.tau)
            _, first = np.unique(r * (self.label.max() + 1) + self.label[c], return_index=True)
            yield own[r[first]], self.index[c[first]]

    def close(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.index is None:
            self.index = np.unique(np.concatenate([*self.parts, np.zeros(0, np.uint64)]))
            self.parts = []
            self.label, edges = _spread(self.index, self.tau)
            yield from edges


def _edge_batch(edges: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    u = np.concatenate([np.zeros(0, np.uint64), *(e[0] for e in edges)])
    v = np.concatenate([np.zeros(0, np.uint64), *(e[1] for e in edges)])
    pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1)[u != v], axis=0).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def link_sorted(batches: Iterator[pa.RecordBatch], tau: int) -> Iterator[pa.RecordBatch]:
    """Edges among rows sorted by key, index rows first: small keys by shifted comparison, others as they come."""
    key_now, key = None, _Key(tau)
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column("key").to_numpy(zero_copy_only=False)
        f = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        x = batch.column("is_index").to_numpy(zero_copy_only=False)
        bounds = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
        sizes = np.diff(bounds)
        small = sizes <= SMALL_RUN
        small[[0, -1]] = False  # may go on in another batch
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        in_small = np.repeat(small & (sizes > 1), sizes)
        ks, fs, xs = k[in_small], f[in_small], x[in_small]
        for shift in range(1, min(SMALL_RUN, len(ks))):
            hit = (ks[shift:] == ks[:-shift]) & (xs[shift:] | xs[:-shift])
            hit &= np.bitwise_count(fs[shift:] ^ fs[:-shift]) <= tau
            edges.append((fs[:-shift][hit], fs[shift:][hit]))
        for at, size in zip(bounds[:-1][~small].tolist(), sizes[~small].tolist(), strict=True):
            if key_now != k[at]:
                edges.extend(key.close())
                key_now, key = k[at], _Key(tau)
            for edge in key.add(f[at : at + size], x[at : at + size]):
                edges.append(edge)
        yield _edge_batch(edges)
    yield _edge_batch(list(key.close()))


def near_edges(classes: DataFrame, tau: int, partitions: int | None = None, hot: int = HOT) -> DataFrame:
    """Spanning edges (a long, b long) of the graph of fingerprints at most ``tau`` bits apart."""
    common.ship(classes.sparkSession)
    pairs, n = bit_pair_counts(classes)
    parts = group_bits(pairs, n, partitions or choose_partitions(n, tau))
    tables = distance_tables(half_histograms(classes, parts), tau)
    rows = probe_rows(classes, parts, tables, n, tau)
    hot_keys = common.materialize(index_keys(classes, parts).groupBy("key").count().where(F.col("count") > hot).select("key"), "hot-keys")
    n_hot = hot_keys.count()
    if n_hot:
        hot_keys = F.broadcast(hot_keys) if n_hot <= BROADCAST_ROWS else hot_keys
        rows = rows.join(hot_keys, "key", "left_anti").unionByName(split_rows(rows.join(hot_keys, "key", "left_semi"), parts, tau))
    tasks = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = rows.repartition(tasks, "key").sortWithinPartitions("key", F.desc("is_index"))
    return dealt.mapInArrow(common.tidy(lambda batches: link_sorted(batches, tau)), "a long, b long")


def classes_and_components(prints: DataFrame, tau: int) -> DataFrame:
    """fp, rep (smallest id with it) and component (smallest fingerprint reachable, as a long) per distinct fingerprint."""
    classes = common.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    nodes = connected_components(near_edges(classes, tau))
    return classes.join(nodes, classes.fp == nodes.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, tau: int = 4, width: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id reachable) for every row."""
    prints = common.materialize(fingerprints(docs, width).drop("row"), "fingerprints")
    labelled = classes_and_components(prints, tau)
    smallest = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    answer = labelled.join(smallest, "component").select("fp", "component_id")
    return prints.join(answer, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
