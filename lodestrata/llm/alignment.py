"""Operator 13: alignment of two tokenizers, by links counted over the whole corpus.

Two tokenizers cut the bytes of " " + text. Offsets where both end a token cut them into
groups, and every token of one side in a group is linked with every token of the other. A
pair of ids is one 64-bit key (id of A, then id of B); its count is the number of documents
that hold it linked.

Counting: every document is encoded once and written with its numbers and its different
keys. A task reduces the keys of its documents with np.unique, Spark sorts these partial
counts over all tasks by ranges of keys, and each range adds up its runs of equal keys and
writes them as a shard: a file of sorted keys and one of counts. Scoring tasks map the
shards into memory and search only their own keys, so no worker holds the table; the
number of different keys is bounded by the two vocabularies, not by the corpus. Shards
carry names of their own and only those that a successful task returned are read.

A text may be cut before each single space between two characters that are not space:
neither tokenizer joins tokens there, so both end a token, and a word's groups do not depend
on its neighbours. Each different word is therefore encoded and aligned once, in a cache of
bounded size. A vocabulary B with a piece that holds a space after another character is
refused, since the cut would not hold for it.

Defined cases: a null or empty text, or one whose joined token bytes on either side differ
from " " + text, has no tokens: zeros, and '' for the hash; repeated rows and null ids are
documents of their own; a very long text, unbroken ones included, is read whole, and a long
group is counted by its different ids; an empty table gives none; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .token_frames import _filesystem, _qualified

ID_BITS = 24
SLICE_BYTES = 2 << 20
PART = 2000
CACHE_KEYS = 3_000_000
CACHE_BYTES = 96 << 20
LONG_GROUP = 1024
OUTER = 1 << 20
PARTIAL_KEYS = 2_000_000
SHARD_KEYS = 2_000_000
CUT = re.compile(r"(?<=\S) (?=\S)")
WORD_END = "▁"


def byte_characters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable character."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Growing:
    """A numpy array that is appended to."""

    def __init__(self, kind: type):
        self.held, self.size = np.empty(1024, kind), 0

    def append(self, values: np.ndarray) -> None:
        if self.size + len(values) > len(self.held):
            bigger = np.empty(max(2 * len(self.held), self.size + len(values)), self.held.dtype)
            bigger[: self.size] = self.held[: self.size]
            self.held = bigger
        self.held[self.size : self.size + len(values)] = values
        self.size += len(values)


def runs(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The positions starts[i], starts[i] + 1, ... of all runs, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


class Aligner:
    """Aligned words: numbers, group texts and linked keys of every word seen, in a cache of bounded size."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        to_byte = byte_characters()
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        a_bytes = [bytes(map(to_byte.__getitem__, e)) if all(c in to_byte for c in e) else e.encode() for e in entries]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search(f"[^{WORD_END}]{WORD_END}", p) for p in pieces):
            raise ValueError("a piece holds a space after another character")
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(WORD_END, " ").encode() for i, p in enumerate(pieces)]
        self.bytes = a_bytes, b_bytes
        self.lengths = tuple(np.array([len(x) for x in side], np.int64) for side in self.bytes)
        size = max(len(a_bytes), len(b_bytes))
        self.names = {end: np.array([f"{i}{end}" for i in range(size)], object) for end in ",|;"}
        if size > 1 << ID_BITS:
            raise ValueError("a vocabulary is too large for packed keys")
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.texts: list[str] = []
        self.held_bytes = 0
        self.numbers = [Growing(np.int64) for _ in range(5)]  # tokens A, tokens B, groups, links, whether aligned
        self.keys, self.weights = Growing(np.int64), Growing(np.int64)
        self.first, self.many = Growing(np.int64), Growing(np.int64)

    def _encode(self, side: int, texts: list[str]) -> list[list[int]]:
        """Ids of " " + text for each text."""
        if side == 0:
            return [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        return self.b.encode(texts, num_threads=1)

    def _ids(self, side: int, words: list[str], sizes: np.ndarray, plain: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all words, number of each word's, whether each word's bytes are " " + word); plain words are encoded as one text."""
        if plain:
            joined = " ".join(words)
            ids = self._encode(side, [joined])[0]
            if b"".join(map(self.bytes[side].__getitem__, ids)) == (" " + joined).encode():
                flat = np.array(ids, np.int64)
                ends, wanted = np.cumsum(self.lengths[side][flat]), np.cumsum(sizes + 1)
                upto = np.searchsorted(ends, wanted) + 1
                if np.array_equal(ends[upto - 1], wanted):
                    return flat, np.diff(upto, prepend=0), np.ones(len(words), bool)
        each = self._encode(side, words)
        same = [b"".join(map(self.bytes[side].__getitem__, ids)) == (" " + w).encode() for w, ids in zip(words, each, strict=True)]
        return np.array([i for ids in each for i in ids], np.int64), np.array([len(ids) for ids in each]), np.array(same, bool)

    def learn(self, words: list[str], plain: bool = True) -> None:
        """Words that neither begin nor end with white space are plain."""
        for lo in range(0, len(words), PART):
            self._learn(words[lo : lo + PART], plain)

    def _learn(self, words: list[str], plain: bool) -> None:
        sizes = pc.binary_length(pa.array(words, pa.string())).to_numpy().astype(np.int64)
        (a, per_a, same_a), (b, per_b, same_b) = self._ids(0, words, sizes, plain), self._ids(1, words, sizes, plain)
        same = same_a & same_b
        a, b = a[np.repeat(same, per_a)], b[np.repeat(same, per_b)]
        per_a, per_b = np.where(same, per_a, 0), np.where(same, per_b, 0)
        ends_a, ends_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        of_a, of_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        size_a, size_b = np.bincount(of_a, minlength=len(cuts)), np.bincount(of_b, minlength=len(cuts))
        word_ends = np.cumsum(per_a)
        word = np.searchsorted(word_ends, np.cumsum(size_a) - 1, "right")  # of each group
        groups = np.bincount(word, minlength=len(words))
        links = np.bincount(word, weights=size_a * size_b, minlength=len(words)).astype(np.int64)
        base = len(self.index)
        self.index.update(zip(words, range(base, base + len(words)), strict=True))
        self._write_groups(a, b, size_a, size_b, groups)
        key_word, keys, weights = self._link(a, b, size_a, size_b, word)
        order = np.argsort(key_word, kind="stable")
        many = np.bincount(key_word, minlength=len(words))
        self.first.append(self.keys.size + np.cumsum(many) - many)
        self.many.append(many)
        self.keys.append(keys[order])
        self.weights.append(weights[order])
        for held, values in zip(self.numbers, (per_a, per_b, groups, links, same), strict=True):
            held.append(np.asarray(values, np.int64))

    def _write_groups(self, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, groups: np.ndarray) -> None:
        """Each word's text a1,a2|b1;a3|b2,b3: every token's name with what follows it, in order of the groups."""
        ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
        said = np.empty(len(a) + len(b), object)
        said[np.arange(len(a)) + np.repeat(ends_b - size_b, size_a)] = self.names[","][a]
        said[np.arange(len(b)) + np.repeat(ends_a, size_b)] = self.names[","][b]
        said[ends_a - 1 + ends_b - size_b] = self.names["|"][a[ends_a - 1]]
        said[ends_a - 1 + ends_b] = self.names[";"][b[ends_b - 1]]
        tokens = said.tolist()
        upto = np.append(0, ends_a + ends_b)[np.cumsum(groups)].tolist()
        texts, lo = [], 0
        for hi in upto:
            texts.append("".join(tokens[lo:hi])[:-1])
            lo = hi
        self.texts += texts
        self.held_bytes += sum(map(len, texts)) + 200 * len(texts)

    @staticmethod
    def _link(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, key, number of links) of what the groups link; a long group gives each pair of ids once."""
        first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        short = size_a * size_b <= LONG_GROUP
        group = np.repeat(np.arange(len(word))[short], size_a[short])
        own_a = a[runs(size_a[short], first_a[short])]
        each = size_b[group]
        keys = [(np.repeat(own_a, each) << ID_BITS) | b[runs(each, first_b[group])]]
        words, weights = [np.repeat(word[group], each)], [np.ones(len(keys[0]), np.int64)]
        for g in np.flatnonzero(~short).tolist():
            ids_a, times_a = np.unique(a[first_a[g] : first_a[g] + size_a[g]], return_counts=True)
            ids_b, times_b = np.unique(b[first_b[g] : first_b[g] + size_b[g]], return_counts=True)
            step = max(1, OUTER // len(ids_b))
            for lo in range(0, len(ids_a), step):
                keys.append(((ids_a[lo : lo + step, None] << ID_BITS) | ids_b).ravel())
                weights.append((times_a[lo : lo + step, None] * times_b).ravel())
                words.append(np.full(len(keys[-1]), word[g]))
        return np.concatenate(words), np.concatenate(keys), np.concatenate(weights)

    def __call__(self, texts: list[str | None]) -> Aligned:
        if self.keys.size > CACHE_KEYS or self.held_bytes > CACHE_BYTES:
            self.forget()
        split = [CUT.split(t) if t else [] for t in texts]
        known = self.index
        fresh = set().union(*split).difference(known)
        edged = fresh.intersection(w for t, words in zip(texts, split, strict=True) if t and (t[0].isspace() or t[-1].isspace()) for w in (words[0], words[-1]))
        self.learn(list(fresh - edged))
        self.learn(list(edged), plain=False)
        lengths = np.array([len(words) for words in split])
        at = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, int(lengths.sum()))
        return Aligned(self, at, lengths)


class Aligned:
    """The documents of a slice: numbers of each, and its different keys with their links."""

    def __init__(self, aligner: Aligner, at: np.ndarray, lengths: np.ndarray):
        doc = np.repeat(np.arange(len(lengths)), lengths)
        wrong = np.bincount(doc, weights=1 - aligner.numbers[4].held[at], minlength=len(lengths)) > 0
        at, doc = at[~wrong[doc]], doc[~wrong[doc]]
        self.lengths = np.where(wrong, 0, lengths)
        self.numbers = []
        for held in aligner.numbers[:4]:
            before = np.append(0, np.cumsum(held.held[at]))
            ends = np.cumsum(self.lengths)
            self.numbers.append(before[ends] - before[ends - self.lengths])
        self.at, self.texts = at, aligner.texts
        own, times = np.unique((doc << 40) | at, return_counts=True)
        doc, word = own >> 40, own & ((1 << 40) - 1)
        many = aligner.many.held[word]
        held = runs(many, aligner.first.held[word])
        packed = (np.repeat(doc, many) << (2 * ID_BITS)) | aligner.keys.held[held]
        weights = np.repeat(times, many) * aligner.weights.held[held]
        order = np.argsort(packed)
        packed = packed[order]
        first = np.flatnonzero(np.append(True, packed[1:] != packed[:-1])) if len(packed) else order
        self.doc = packed[first] >> (2 * ID_BITS)
        self.keys = packed[first] & ((1 << 2 * ID_BITS) - 1)
        self.weights = np.add.reduceat(weights[order], first) if len(first) else weights

    def hashes(self) -> list[str]:
        out, lo, at = [], 0, self.at.tolist()
        for n in self.lengths.tolist():
            said = ";".join([self.texts[i] for i in at[lo : lo + n]])
            out.append(hashlib.sha256(said.encode()).hexdigest() if n else "")
            lo += n
        return out


def aligner(path_a: str, path_b: str) -> Aligner:
    """One pair of tokenizers a worker process; what they have learned goes when a task ends."""
    held = common.process_cache().setdefault("aligners", {})
    if (path_a, path_b) not in held:
        held[path_a, path_b] = Aligner(path_a, path_b)
    return held[path_a, path_b]


def added_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys and the sums of their counts."""
    every, of_every = np.concatenate(keys), np.concatenate(counts)
    found, which = np.unique(every, return_inverse=True)
    out = np.zeros(len(found), np.int64)
    np.add.at(out, which, of_every)
    return found, out


ENCODED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys array<long>, links array<long>"


def encoded(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Each document's numbers, and its different keys with the links of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(path_a, path_b)
        try:
            for batch in batches:
                for part in common.slices(batch, SLICE_BYTES):
                    found = align(part.column("text").to_pylist())
                    offsets = pa.array(np.searchsorted(found.doc, np.arange(part.num_rows + 1)), pa.int32())
                    lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int64())) for v in (found.keys, found.weights)]
                    columns = [part.column("doc_id"), *(pa.array(v, pa.int64()) for v in found.numbers), pa.array(found.hashes(), pa.string()), *lists]
                    yield pa.RecordBatch.from_arrays(columns, names(ENCODED))
        finally:
            align.forget()

    return docs.mapInArrow(common.tidy(run), ENCODED)


def names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def partial_counts(documents: DataFrame) -> DataFrame:
    """key, n: documents of a task that hold the pair linked; a task gives a key again only beyond ``PARTIAL_KEYS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size, kept = [], [], 0, 0

        def rows() -> Iterator[pa.RecordBatch]:
            found, n = added_up(keys, counts)
            for lo in range(0, len(found), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(found[lo : lo + (1 << 16)]), pa.array(n[lo : lo + (1 << 16)])], ["key", "n"])

        for batch in batches:
            found, n = np.unique(batch.column("keys").flatten().to_numpy(), return_counts=True)
            keys.append(found)
            counts.append(n.astype(np.int64))
            size += len(found)
            if size > 2 * kept + PARTIAL_KEYS:
                found, n = added_up(keys, counts)
                keys, counts, size, kept = [found], [n], len(found), len(found)
                if kept > PARTIAL_KEYS:
                    yield from rows()
                    keys, counts, size, kept = [], [], 0, 0
        if keys:
            yield from rows()

    return documents.select("keys").mapInArrow(common.tidy(run), "key long, n long")


def write_shards(partial: DataFrame, directory: str) -> DataFrame:
    """a, best, shard, first, last, size: for each shard a row for each of its A ids with their highest count there."""
    n = partial.count()
    directory = _qualified(partial.sparkSession, directory)
    dealt = partial.repartitionByRange(max(1, -(-n // SHARD_KEYS)), "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, path = _filesystem(directory)
        name = uuid.uuid4().hex
        best: dict[int, int] = {}
        first = last = None
        size = 0
        sinks = None

        def write(keys: np.ndarray, counts: np.ndarray) -> None:
            nonlocal first, last, size
            first = int(keys[0]) if first is None else first
            last, size = int(keys[-1]), size + len(keys)
            for sink, values in zip(sinks, (keys, counts), strict=True):
                sink.write(values.astype("<i8").tobytes())
            own = keys >> ID_BITS
            start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            for a, most in zip(own[start].tolist(), np.maximum.reduceat(counts, start).tolist(), strict=True):
                best[a] = max(most, best.get(a, 0))

        open_key = np.zeros(0, np.int64)
        open_count = np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            if sinks is None:
                target.create_dir(path, recursive=True)
                sinks = [target.open_output_stream(f"{path}/{name}.{kind}") for kind in ("keys", "counts")]
            keys = np.append(open_key, batch.column("key").to_numpy())
            counts = np.append(open_count, batch.column("n").to_numpy())
            start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            keys, counts = keys[start], np.add.reduceat(counts, start)
            open_key, open_count = keys[-1:], counts[-1:]  # its run may go on in the next batch
            if len(keys) > 1:
                write(keys[:-1], counts[:-1])
        if sinks is not None:
            write(open_key, open_count)
            for sink in sinks:
                sink.close()
            m = len(best)
            columns = [pa.array(list(best), pa.int64()), pa.array(list(best.values()), pa.int64()), pa.array([name] * m), *(pa.array([v] * m, pa.int64()) for v in (first, last, size))]
            yield pa.RecordBatch.from_arrays(columns, ["a", "best", "shard", "first", "last", "size"])

    return dealt.mapInArrow(common.tidy(run), "a long, best long, shard string, first long, last long, size long")


class Shards:
    """Sorted keys and counts, mapped into memory file by file as they are needed."""

    def __init__(self, directory: str, manifest: list[tuple[int, int, str, int]]):
        self.directory, self.manifest = directory, sorted(manifest)
        self.lasts = np.array([last for _, last, _, _ in self.manifest], np.int64)
        self.mapped: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _map(self, file: str, size: int) -> np.ndarray:
        target, path = _filesystem(self.directory)
        if self.directory.startswith("file:"):
            return np.memmap(f"{path}/{file}", "<i8", "r", shape=(size,))
        copy, local = tempfile.mkstemp()  # a store without local paths: an unnamed copy that goes with the mapping
        with os.fdopen(copy, "wb") as out, target.open_input_stream(f"{path}/{file}") as source:
            while block := source.read(1 << 22):
                out.write(block)
        mapped = np.memmap(local, "<i8", "r", shape=(size,))
        os.unlink(local)
        return mapped

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The counts of sorted keys, all of which were counted."""
        out = np.zeros(len(keys), np.int64)
        shard = np.searchsorted(self.lasts, keys)
        cuts = np.searchsorted(shard, np.arange(len(self.lasts) + 1))
        for i in np.unique(shard).tolist():
            if i not in self.mapped:
                _, _, name, size = self.manifest[i]
                self.mapped[i] = self._map(f"{name}.keys", size), self._map(f"{name}.counts", size)
            held, counts = self.mapped[i]
            own = keys[cuts[i] : cuts[i + 1]]
            at = np.searchsorted(held, own)
            if not np.array_equal(held[at], own):
                raise ValueError("a linked pair was not counted")
            out[cuts[i] : cuts[i + 1]] = counts[at]
        return out


OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def count_links(documents: DataFrame, directory: str) -> tuple[list[tuple[int, int, str, int]], dict[int, int]]:
    """Writes the corpus's counts as shards; (manifest, highest count of each A id).

    What comes to the driver is a row a shard and one an id of A: both are bounded by the vocabularies.
    """
    partial = common.materialize(partial_counts(documents), "pair-counts")
    shards = common.materialize(write_shards(partial, directory), "pair-shards")
    manifest = [tuple(r) for r in shards.select("first", "last", "shard", "size").distinct().collect()]
    return manifest, dict(shards.groupBy("a").agg(F.max("best")).collect())


def align(docs: DataFrame, path_a: str, path_b: str, directory: str | None = None) -> DataFrame:
    """One row for each document: its tokens, groups and links, and how its links stand in the corpus."""
    spark: SparkSession = docs.sparkSession
    common.ship(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    documents = common.materialize(encoded(source, path_a, path_b), "aligned")
    directory = _qualified(spark, directory or common.fresh_path(spark, "pair-index"))
    manifest, best = count_links(documents, directory)
    highest = np.zeros(max(best, default=0) + 1, np.int64)
    highest[list(best)] = list(best.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(directory, manifest)
        for batch in batches:
            lists = batch.column("keys")
            offsets = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))
            links = batch.column("links").flatten().to_numpy()
            keys, which = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            counts = shards.counts(keys)

            def per_document(values: np.ndarray, offsets: np.ndarray = offsets) -> pa.Array:
                before = np.append(0, np.cumsum(values))
                return pa.array(before[offsets[1:]] - before[offsets[:-1]], pa.int64())

            more = {"n_best": per_document(links * (counts == highest[keys >> ID_BITS])[which]), "count_sum": per_document(links * counts[which])}
            yield pa.RecordBatch.from_arrays([more[c] if c in more else batch.column(c) for c in names(OUT)], names(OUT))

    return documents.mapInArrow(common.tidy(run), OUT)
