"""Operator 4: language-model scoring from a log-frequency Bloom filter.

Blocks. Every text is cut into words and one end token. Python encodes a block
of texts at a time and deals the block's distinct 1-grams and 2-grams, each with
its count in the block's training texts, to segments by hash. A segment's rows
meet in one task, which answers each block for the n-grams it asked about; the
answers then meet their block again, which is scored. Nothing is broadcast or
collected but three sums, so what is gathered grows with the corpus, and so does
the number of segments.

Filter. Each segment's counted 2-grams go to a filter of its own. An n-gram of
count c is stored at the levels 1..q(c), with q(c) = 1 + floor(log_b c): the
quantised count is read back by probing level after level until one is missing.
The filter has ``BITS_STORED`` bits for each entry its n-grams need, so that
every level of every n-gram is kept. (``build_segment`` with fewer bits would
raise the lowest stored level.) Counts of 1-grams are exact.

Scoring. P(w | v) = (c(v,w) + mu * P(w)) / (c(v) + mu) with c(v,w) probed from
the filter and never above c(v) or c(w), P(w) add-half smoothed. ``score`` is the
sum of log10 P over the words and the end token, the first word's history being
a start mark. ``base_score`` is the sum of log10 P(w).

Defined cases: null and empty texts are the single end token; without training
texts all counts are zero; repeated rows are counted and scored each, equal texts
alike; a very long text is a block of its own and is scored whole; null ids
count as the text '' in the fold; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

END = b"\n"  # no word holds white space
START_HASH = np.uint64(0x5157415254)
BASE = 1.25
PROBES = 4
SEGMENTS = 4096
SEGMENT_BYTES = 2 << 20  # of text
BITS_PER_ENTRY, BITS_STORED = 8, 16
MU = 30.0
BLOCK, BLOCK_BYTES = 8192, 16 << 20
HASH_BYTES = 6  # sent of a 2-gram's hash, below the bits that name its segment
WORDS, PAIRS, TEXTS = 0, 1, 2
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def tokens(text: str | None) -> list[bytes]:
    out = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out.append(END)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(w, 17) for w in words], np.uint64, len(words))


def level_of(count: np.ndarray) -> np.ndarray:
    """q(c) for c >= 1."""
    return 1 + np.floor(np.log(count) / np.log(BASE) + 1e-9).astype(np.int64)


def count_of(level: np.ndarray) -> np.ndarray:
    """The middle (geometric) of the integers whose level it is; 0 for level 0."""
    low = np.ceil(BASE ** (level - 1.0) - 1e-9)
    high = np.maximum(np.ceil(BASE ** (1.0 * level) - 1e-9) - 1, low)
    return np.where(level > 0, np.sqrt(low * high), 0.0)


@dataclass
class Encoded:
    """A block of texts as numbers: distinct words, each position's word, each text's extent."""

    words: list[bytes]
    hashes: np.ndarray
    at: np.ndarray
    ends: np.ndarray  # position after each text

    def pairs(self) -> np.ndarray:
        """Hash of (previous, this) at every position; the start mark precedes each text."""
        own = self.hashes[self.at]
        before = np.empty_like(own)
        before[1:] = own[:-1]
        before[np.concatenate([[0], self.ends[:-1]])] = START_HASH
        return mix(before * M1 + own * M2 + M3)


class _Numbers(dict):
    """Numbers words in the order they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def encode(texts: list[str | None]) -> Encoded:
    number = _Numbers()
    flat = array("i")
    ends = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        flat.extend(map(number.__getitem__, tokens(t)))
        ends[i] = len(flat)
    words = list(number)
    return Encoded(words, word_hashes(words), np.frombuffer(flat, np.int32), ends)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most ``BLOCK`` rows and, but for a single longer text, ``BLOCK_BYTES`` bytes at a time."""
    for batch in batches:
        sizes = batch.column("bytes").to_pylist()
        lo = held = 0
        for i, size in enumerate(sizes):
            if i > lo and (i - lo == BLOCK or held + size > BLOCK_BYTES):
                yield batch.slice(lo, i - lo)
                lo, held = i, 0
            held += size
        if lo < len(sizes):
            yield batch.slice(lo)


ROW = "segment int, kind int, block long, body binary, n binary, texts long, tokens long, types long"
ROW_ARROW = pa.schema(
    [("segment", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("body", pa.binary()), ("n", pa.binary())]
    + [(c, pa.int64()) for c in ("texts", "tokens", "types")]
)


def _row_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(ROW_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ROW_ARROW, strict=True)], schema=ROW_ARROW)


def _list(values: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def squeeze(values: np.ndarray | bytes, width: int = 1) -> bytes:
    """Bytes compressed; of integers the lowest ``width`` bytes, plane by plane, as like bytes compress together."""
    raw = values if isinstance(values, bytes) else np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1)[:, :width].T).tobytes()
    return len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def unsqueeze(body: bytes) -> bytes:
    return pa.decompress(body[4:], int.from_bytes(body[:4], "little"), "zstd", asbytes=True)


def integers(body: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(body), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _packed(columns: dict[str, pa.Array]) -> bytes:
    batch = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(body: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(body) as r:
        return r.read_next_batch()


def _slices(hashes: np.ndarray, segments: int) -> Iterator[tuple[int, int, int]]:
    """(segment, first, end) of sorted hashes; the segment is the hash's highest bits."""
    own = (hashes >> np.uint64(64 - segments.bit_length() + 1)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]])).tolist()
    return ((int(own[a]), a, z) for a, z in zip(cuts[:-1], cuts[1:], strict=True))


def block_rows(rows: DataFrame, segments: int) -> DataFrame:
    """Per block: its n-grams with training counts, a row for each segment, and the encoded texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            e = encode(batch.column("text").to_pylist())
            block = batch.column("row")[0].as_py()
            held = np.asarray(batch.column("held_out").to_pylist(), bool)
            lengths = np.diff(e.ends, prepend=0)
            train = np.repeat(~held, lengths)
            out = []
            order = np.argsort(e.hashes, kind="stable")
            ones = np.bincount(e.at[train], minlength=len(e.words)).astype("<u4")[order]
            for s, a, z in _slices(e.hashes[order], segments):
                out.append((s, WORDS, block, squeeze(b" ".join([e.words[i] for i in order[a:z].tolist()])), squeeze(ones[a:z], 4), None, None, None))
            pairs, back = np.unique(e.pairs(), return_inverse=True)
            twos = np.bincount(back[train], minlength=len(pairs)).astype("<u4")
            below = pairs << np.uint64(segments.bit_length() - 1) >> np.uint64(64 - 8 * HASH_BYTES)
            for s, a, z in _slices(pairs, segments):
                out.append((s, PAIRS, block, squeeze(below[a:z], HASH_BYTES), squeeze(twos[a:z], 4), None, None, None))
            body = _packed(
                {"doc_id": pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), batch.column("doc_id")), "held_out": _list(held), "length": _list(lengths), "at": pa.array([squeeze(e.at, 4)], pa.binary()), "hash": _list(e.hashes)}
            )
            # Dealt by its number, so that texts spread over the tasks as n-grams do.
            s = int(mix(np.array([block], np.uint64))[0] % np.uint64(segments))
            out.append((s, TEXTS, block, body, None, int((~held).sum()), int(train.sum()), None))
            yield _row_batch(out)

    return rows.mapInArrow(common.tidy(run), ROW)


def positions(h: np.ndarray, level: np.ndarray, bits: int) -> list[np.ndarray]:
    """Bit positions inside the n-gram's segment, one array per probe."""
    x = mix(h * M2 + level.astype(np.uint64) * M1)
    step = mix(x + M3) | np.uint64(1)
    return [((x + np.uint64(i) * step) % np.uint64(bits)).astype(np.int64) for i in range(PROBES)]


def build_segment(h: np.ndarray, n: np.ndarray, bits: int) -> tuple[int, np.ndarray]:
    """(lowest stored level, bit array) of one segment."""
    q = level_of(n)
    lowest, capacity = 1, bits // BITS_PER_ENTRY
    per_level = np.cumsum(np.bincount(q, minlength=2)[::-1])[::-1]  # entries at each level
    total = np.cumsum(per_level[::-1])[::-1]  # entries at this level and above
    while lowest < len(total) - 1 and total[lowest] > capacity:
        lowest += 1
    filled = np.zeros(bits, bool)
    for level in range(lowest, int(q.max(initial=0)) + 1):
        own = h[q >= level]
        for p in positions(own, np.full(len(own), level), bits):
            filled[p] = True
    return lowest, np.packbits(filled, bitorder="little")


class Filter:
    """Segments of ``bits`` bits side by side; quantised counts are read by repeated membership probes."""

    def __init__(self, bits: int, lowest: np.ndarray, data: np.ndarray):
        self.bits, self.lowest, self.data = bits, lowest, data

    def levels(self, h: np.ndarray) -> np.ndarray:
        seg = (mix(h) % np.uint64(len(self.lowest))).astype(np.int64)
        level = self.lowest[seg] - 1
        floor = level.copy()
        live = np.arange(len(h))
        while len(live):
            nxt = level[live] + 1
            ok = np.ones(len(live), bool)
            base = seg[live] * self.bits
            for p in positions(h[live], nxt, self.bits):
                at = base + p
                ok &= (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            live = live[ok]
            level[live] += 1
        return np.where(level > floor, level, 0)

    def counts(self, h: np.ndarray) -> np.ndarray:
        return count_of(self.levels(h))


def whole_filter(h: np.ndarray, n: np.ndarray) -> Filter:
    """One segment with room for every level of every n-gram."""
    bits = max(64, -(-int(level_of(n).sum()) * BITS_STORED // 8) * 8)
    lowest, data = build_segment(h, n, bits)
    return Filter(bits, np.array([lowest]), data)


def answer_pairs(asked: list[np.ndarray], counts: list[np.ndarray]) -> list[bytes]:
    """The filter's level for each 2-gram asked about, one byte each."""
    h, back = np.unique(np.concatenate(asked), return_inverse=True)
    n = np.bincount(back, np.concatenate(counts), len(h)).astype(np.int64)
    level = whole_filter(h[n > 0], n[n > 0]).levels(h).astype(np.uint8)[back]
    return [squeeze(x) for x in np.split(level, np.cumsum([len(x) for x in asked])[:-1])]


def answer_words(asked: list[list[bytes]], counts: list[np.ndarray]) -> tuple[list[bytes], int]:
    """The exact training count of each word asked about, and the number of words that have one."""
    number = _Numbers()
    at = [np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)) for ws in asked]
    n = np.bincount(np.concatenate(at), np.concatenate(counts), len(number)).astype("<u8")
    return [squeeze(n[x], 8) for x in at], int((n > 0).sum())


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Runs of rows with equal keys."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(row[k] != held[-1][k] for k in keys):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def answer_rows(dealt: DataFrame) -> DataFrame:
    """Rows sorted by segment and kind, with answers for the n-grams; encoded texts pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["segment", "kind"]):
            segment, kind, types = group[0]["segment"], group[0]["kind"], 0
            if kind == TEXTS:
                for r in group:
                    yield _row_batch([tuple(r[c] for c in ROW_ARROW.names)])
                continue
            counts = [integers(r["n"], 4) for r in group]
            if kind == WORDS:
                bodies, types = answer_words([unsqueeze(r["body"]).split(b" ") for r in group], counts)
            else:
                bodies = answer_pairs([integers(r["body"], HASH_BYTES) for r in group], counts)
            yield _row_batch([(segment, kind, r["block"], body, None, None, None, 0 if i else types) for i, (r, body) in enumerate(zip(group, bodies, strict=True))])

    return dealt.mapInArrow(common.tidy(run), ROW)


def score_blocks(met: DataFrame, texts: int, total: int, distinct: int) -> DataFrame:
    """The answer's rows from each block's answers and encoded texts, sorted by block, kind and segment."""
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scale = total + 0.5 * (distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["block"]):
            said = {k: np.concatenate([integers(r["body"], w) for r in group if r["kind"] == k]) for k, w in ((WORDS, 8), (PAIRS, 1))}
            block = _unpacked(group[-1]["body"])
            lengths, hashes = (block.column(c).values.to_numpy() for c in ("length", "hash"))
            at = integers(block.column("at")[0].as_py(), 4).astype(np.int32)
            e = Encoded([], hashes, at, np.cumsum(lengths))
            docs, starts = len(lengths), e.ends - lengths
            doc = np.repeat(np.arange(docs), lengths)
            ones = np.zeros(len(hashes))
            ones[np.argsort(hashes, kind="stable")] = said[WORDS]
            twos = count_of(said[PAIRS].astype(np.int64))[np.unique(e.pairs(), return_inverse=True)[1]]
            own = ones[at]
            before = np.empty_like(own)
            before[1:] = own[:-1]
            before[starts] = texts
            p_word = (own + 0.5) / scale
            p = (np.minimum(twos, np.minimum(before, own)) + MU * p_word) / (before + MU)
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id").values,
                    block.column("held_out").values,
                    pa.array(lengths),
                    pa.array(np.bincount(doc[own > 0], minlength=docs).astype(np.int64)),
                    pa.array(np.full(docs, total, np.int64)),
                    pa.array(np.bincount(doc, np.log10(p_word), docs)),
                    pa.array(np.bincount(doc, np.log10(np.minimum(p, 1.0)), docs)),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return met.mapInArrow(common.tidy(run), schema)


def segment_count(size: int) -> int:
    """A power of two that grows with the bytes of text."""
    n = SEGMENTS // 4
    while n * SEGMENT_BYTES < size:
        n *= 2
    return n


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = docs.sparkSession
    common.ship(spark)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        (common.fold("doc_id", 5) == 1).alias("held_out"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("bytes", F.octet_length("text"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    # A task's rows come to Python in few Arrow batches: some blocks' worth of bytes a task.
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), size // (8 * BLOCK_BYTES))
    dealt = block_rows(rows, segment_count(size)).repartition(tasks, "segment").sortWithinPartitions("segment", "kind", "block")
    answered = common.materialize(answer_rows(dealt), "answers")
    texts, total, distinct = answered.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("texts", "tokens", "types")]).first()
    met = answered.repartition(tasks, "block").sortWithinPartitions("block", "kind", "segment")
    return score_blocks(met.select("block", "kind", "body"), texts, total, distinct)
