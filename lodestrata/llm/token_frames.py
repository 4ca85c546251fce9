"""Operator 7: token ids in seekable zstandard files.

File format: one independent zstandard frame per run of documents, then a seek
table in a skippable frame: for each frame its compressed size, decompressed
size and the low 32 bits of the XXH64 of the decompressed bytes (little endian),
closed by the frame count, a descriptor byte and the seekable magic number. The
content of a frame is a small header (document count, then id, token count for
each document) followed by the ids as little-endian unsigned 32-bit integers.
A second skippable frame before the seek table lists the first and last id of
each frame, so a reader opens only the frames that hold a requested document.

Tasks write under a unique name and rename when the file is whole; only names
that a successful task returned are ever read, so retries and lost executors
leave no partial file in the result.

Defined cases: a null text counts as empty and is written as the single end
id; the text of a special token gets that token's id, as the library's plain call
gives it; repeated ids are kept as separate documents (ordered by a hash of their
text, then by the text); null ids sort first; a very long text is one document of
one frame; an empty table writes nothing and gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SKIPPABLE_INDEX = 0x184D2A5D
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FRAME_BYTES = 1 << 20
CACHE_BYTES = 96 << 20
FILE_BYTES = 64 << 20
SLICE_BYTES = 8 << 20
ASCII_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
WIDE_SPACE = [c for c in map(chr, range(0x80, 0x3001)) if c.isspace()]
NULL_ID = -(1 << 63)


class Encoder:
    """Encodes whole texts with the tokenizers library, each distinct space-delimited word once.

    The byte-level pre-tokenizer never joins a non-space character to a space
    that follows it, so a text may be cut before each single space that stands
    between two non-space characters; the ids of the parts, in order, are the
    ids of the whole. Unknown words are encoded together, as one text, and the
    byte length of every id tells where one word's ids end. Texts with other
    white space (tabs, doubled spaces, spaces beside line ends) or the text of a
    special token are encoded whole. Words are kept in two generations of
    ``CACHE_BYTES``, so memory stays bounded and frequent words stay.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        alphabet = byte_alphabet()
        size = self.tokenizer.get_vocab_size()
        pieces = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.byte_length = np.array([len(x) if all(c in alphabet for c in x) else len(x.encode()) for x in pieces], np.int64)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}
        self.held = self.heads_held = 0

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in found]

    def _learn(self, words: list[str]) -> None:
        """Adds the ids of " word" for words that the newer generation lacks."""
        fresh = []
        for w in words:
            ids = self.older.get(w)
            if ids is None:
                fresh.append(w)
            else:
                self.words[w] = ids
        self.held += sum(map(len, words)) + 220 * len(words)
        for lo in range(0, len(fresh), 20_000):
            part = fresh[lo : lo + 20_000]
            raw = self._encode([" " + " ".join(part)])[0]
            ends = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in part), np.int64, len(part)))
            reached = np.cumsum(self.byte_length[np.frombuffer(raw, "<u4")])
            cuts = np.searchsorted(reached, ends) + 1
            if not np.array_equal(reached[cuts - 1], ends):
                raise ValueError("ids do not end where words end")
            at = 0
            for w, cut in zip(part, (4 * cuts).tolist(), strict=True):
                self.words[w] = raw[at:cut]
                at = cut

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.held > CACHE_BYTES:  # before the lookups below, which count on what stays
            self.words, self.older, self.held = {}, self.words, 0
        out: list[bytes | None] = [None] * len(texts)
        whole: list[int] = []
        parts: list[tuple[int, list[str]]] = []
        for i, text in enumerate(texts):
            if odd_space(text) or any(s in text for s in self.special):
                whole.append(i)
            else:
                parts.append((i, text.split(" ")))
        needed: set[str] = set()
        heads = []
        for _, words in parts:
            if words[0] not in self.heads:
                heads.append(words[0])
            needed.update(words)
        self._learn([w for w in needed if w and w not in self.words])
        if self.heads_held > CACHE_BYTES // 4:
            self.heads, self.heads_held = {}, 0
            heads = [words[0] for _, words in parts]
        self.heads_held += sum(map(len, heads)) + 220 * len(heads)
        self.heads.update(zip(heads, self._encode(heads), strict=True))
        get = self.words.__getitem__
        for i, words in parts:
            out[i] = self.heads[words[0]] + b"".join(map(get, words[1:]))
        for i, ids in zip(whole, self._encode([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out  # type: ignore[return-value]


def byte_alphabet() -> set[str]:
    """The printable characters that stand for single bytes in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b) for b in shown} | {chr(256 + i) for i in range(len(hidden))}


def odd_space(text: str) -> bool:
    """Whether ``text`` has white space other than single spaces and line feeds between words."""
    if text.startswith((" ", "\n")) or text.endswith(" ") or "  " in text or " \n" in text or "\n " in text:
        return True
    if any(c in text for c in ASCII_SPACE):
        return True
    return not text.isascii() and any(c in text for c in WIDE_SPACE)


def encoder(path: str) -> Encoder:
    held = common.process_cache().setdefault("encoders", {})
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


class FrameWriter:
    """Writes documents in the order given; frames close after ``frame_bytes`` of ids."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self.sink, self.frame_bytes = sink, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.pending: list[tuple[int, bytes]] = []
        self.pending_bytes = 0
        self.seek: list[tuple[int, int, int]] = []
        self.ranges: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.pending.append((NULL_ID if doc_id is None else doc_id, ids))
        self.pending_bytes += len(ids)
        if self.pending_bytes >= self.frame_bytes:
            self._close_frame()

    def _close_frame(self) -> None:
        import xxhash

        if not self.pending:
            return
        head = np.array([[d, len(b) // 4] for d, b in self.pending], dtype="<i8")
        body = struct.pack("<q", len(self.pending)) + head.tobytes() + b"".join(b for _, b in self.pending)
        packed = self.compressor.compress(body)
        self.sink.write(packed)
        self.seek.append((len(packed), len(body), xxhash.xxh64_intdigest(body) & 0xFFFFFFFF))
        self.ranges.append((self.pending[0][0], self.pending[-1][0], len(self.pending)))
        self.pending, self.pending_bytes = [], 0

    def close(self) -> None:
        self._close_frame()
        index = b"".join(struct.pack("<qqq", *r) for r in self.ranges)
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        entries = b"".join(struct.pack("<III", *e) for e in self.seek)
        footer = struct.pack("<IBI", len(self.seek), 0x80, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(entries) + len(footer)) + entries + footer)


class FrameReader:
    """Random access to a file of ``FrameWriter``; every frame read is checked against its checksum."""

    def __init__(self, source):
        import zstandard

        self.source = source
        self.decompressor = zstandard.ZstdDecompressor()
        size = source.size()
        source.seek(size - 9)
        count, descriptor, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC or descriptor != 0x80:
            raise ValueError("not a seekable file with checksums")
        source.seek(size - 9 - 12 * count)
        self.seek = [struct.unpack("<III", source.read(12)) for _ in range(count)]
        self.offsets = np.concatenate([[0], np.cumsum([s[0] for s in self.seek])]).astype(int) if count else np.zeros(1, int)
        source.seek(int(self.offsets[-1]))
        magic, length = struct.unpack("<II", source.read(8))
        if magic != SKIPPABLE_INDEX or length != 24 * count:
            raise ValueError("damaged index")
        raw = source.read(length)
        self.ranges = [struct.unpack_from("<qqq", raw, 24 * i) for i in range(count)]
        self.frames_read = 0

    def frame(self, i: int) -> Iterator[tuple[int | None, bytes]]:
        import xxhash

        self.source.seek(int(self.offsets[i]))
        body = self.decompressor.decompress(self.source.read(self.seek[i][0]))
        if len(body) != self.seek[i][1] or xxhash.xxh64_intdigest(body) & 0xFFFFFFFF != self.seek[i][2]:
            raise ValueError(f"frame {i} fails its checksum")
        self.frames_read += 1
        (n,) = struct.unpack_from("<q", body)
        head = np.frombuffer(body, "<i8", 2 * n, 8).reshape(n, 2)
        at = 8 + 16 * n
        for d, tokens in head.tolist():
            yield (None if d == NULL_ID else d), body[at : at + 4 * tokens]
            at += 4 * tokens

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        for i in range(len(self.seek)):
            yield from self.frame(i)

    def find(self, doc_id: int) -> list[bytes]:
        """Ids of the documents with this id, from the frames whose range may hold it."""
        return [
            ids
            for i, (low, high, _) in enumerate(self.ranges)
            if low <= doc_id <= high
            for d, ids in self.frame(i)
            if d == doc_id
        ]


def _qualified(spark: SparkSession, directory: str) -> str:
    """``directory`` with its scheme, as Spark resolves it: without one it is on the default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    return fs.FileSystem.from_uri(uri)


def file_count(docs: DataFrame) -> int:
    """One file for each ``FILE_BYTES`` of text; small corpora still give every task slot a megabyte or more."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    slots = docs.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-size // FILE_BYTES), min(4 * slots, size >> 20))


def write_token_files(docs: DataFrame, directory: str, tokenizer: str, end_id: int = 0, files: int | None = None) -> DataFrame:
    """Encode every text and write files in ascending id order; one manifest row per file."""
    spark = docs.sparkSession
    common.ship(spark)
    files = files or file_count(docs)
    directory = _qualified(spark, directory)
    # Ranges go by numbers only: their sample reaches the driver, and texts must not.
    text = F.coalesce("text", F.lit(""))
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
        .repartitionByRange(files, "doc_id", "h")
        .sortWithinPartitions("doc_id", "h", "text")
        .drop("h")
        .withColumn("part", F.spark_partition_id())
    )
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, path = _filesystem(directory)
        writer = sink = name = None
        part = documents = tokens = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                part = batch.column("part")[0].as_py()
                name = f"{path}/part-{part:06d}-{uuid.uuid4().hex}"
                target.create_dir(path, recursive=True)
                sink = target.open_output_stream(f"{name}.writing")
                writer = FrameWriter(sink)
            encode = encoder(tokenizer)
            for piece in common.slices(batch, SLICE_BYTES):
                for d, ids in zip(piece.column("doc_id").to_pylist(), encode(piece.column("text").to_pylist()), strict=True):
                    writer.add(d, ids + end)
                    documents += 1
                    tokens += len(ids) // 4 + 1
        if writer is not None:
            writer.close()
            sink.close()
            target.move(f"{name}.writing", f"{name}.tok.zst")
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "file": [f"{name.rpartition('/')[2]}.tok.zst"], "documents": pa.array([documents], pa.int64()), "tokens": pa.array([tokens], pa.int64())}
            )

    return ordered.mapInArrow(common.tidy(write), "part int, file string, documents long, tokens long")


def read_token_files(spark: SparkSession, manifest: DataFrame, directory: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files that the manifest names."""
    common.ship(spark)
    directory = _qualified(spark, directory)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    starts = manifest.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("first"))
    n = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, path = _filesystem(directory)
        for batch in batches:
            for file, first in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist(), strict=True):
                with target.open_input_file(f"{path}/{file}") as source:
                    reader, start = FrameReader(source), first
                    for i in range(len(reader.seek)):
                        ids, at, counts, sums = [], [], [], []
                        for d, raw in reader.frame(i):
                            ids.append(d)
                            at.append(start)
                            counts.append(len(raw) // 4)
                            sums.append(zlib.crc32(raw))
                            start += len(raw) // 4
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, at, counts, sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return starts.repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, directory: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and read them back."""
    spark = docs.sparkSession
    directory = directory or common.fresh_path(spark, "tokens")
    manifest = common.materialize(write_token_files(docs, directory, tokenizer), "token-manifest")
    return read_token_files(spark, manifest, directory)
