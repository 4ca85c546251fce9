"""Operator 12: main text of web pages, by the runs that a host's pages repeat and by markup.

A page is read into blocks, each with a rank: outside (menus, headers, footers, sidebars,
notices, adverts, forms, comments by their element, role, class or id), undecided, in an
element named as content, in the main element, in an article. All its words, those of the
article too, are its stream.

The streams of a host are concatenated and their suffixes sorted to a depth of ``RUN`` words;
suffixes that agree so far are one substring, and one that stands in ``PAGES`` different
streams of the host or more is repeated, as is every longer run made of such. Every page's
words get these marks, and the page's text is cut from its stream by them and by the ranks:

* where no block ranks above undecided, the host decides: undecided blocks that are covered
  whole by repeated runs go, and so do covered runs of ``RUN`` words within a block; unique
  runs stay, with shorter ends that only follow a neighbour's run;
* where the markup names an article or another content element, the blocks of the highest
  rank are the text, and whole: copies and shared passages are texts too, so there a repeated
  run is counted (``n_repeated``) and not taken away.

Pages are dealt to blocks of bounded size as they are read. What blocks exchange is numbers:
of every run of ``RUN`` words the least hash of its ``GRAM``-word parts, which stands wherever
the run does; where that is repeated, the suffixes are sorted and the substrings' own hashes
(80 bits) follow. Spark adds both up over the blocks, so the result is the same however the
pages are cut. Pages with the same stream count once.

Defined cases: a null or empty page, or one without a kept word, has the empty text; a
null url is a host of its own name, ''; repeated rows are each returned; an empty table
gives none; markup that is never closed reaches to the end of its parent, a tag, comment
or script that is never closed to the end of the page; a page longer than a block is in
one block all the same; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RUN = 8
GRAM = 5
GRAM_BITS = 36
PAGES = 3
BLOCK_WORDS = 1 << 20
SLICE_BYTES = 4 << 20
#: Bytes of pages whose hashes are added up in one group.
RANGE_BYTES = 64 << 20

OUTSIDE, UNDECIDED, NAMED, MAIN, ARTICLE = range(5)

RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "svg", "template", "noscript", "object", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var".split())
OUTSIDE_ELEMENTS = {"nav", "footer", "aside", "form", "dialog", "menu", "select", "button", "label", "fieldset"}
OUTSIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "form", "menu", "menubar", "status"}
OUTSIDE_WORDS = set(
    """ad ads adbox adslot adunit adsbygoogle advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promotion banner
    nav navbar navigation menu menubar submenu breadcrumb breadcrumbs pagination pager sidebar sidebars aside
    footer foot masthead cookie cookies consent gdpr notice notices alert popup modal overlay disclaimer newsletter subscribe
    subscription signup login share sharing social comment comments commentlist reply replies discussion respond disqus related recommended widget widgets
    toolbar topbar skip search""".split()
)
PAGE_ONLY_WORDS = {"header", "head", "top"}
CONTENT_WORDS = {"article", "content", "entry", "story", "post", "main"}
#: A start tag of the first kind ends an open element of the second, unless one of the third stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "option": ({"option"}, {"select"}),
}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z>][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME_PARTS = re.compile(r"[^A-Za-z]+")
CAPITALS = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    found = HOST.match(url or "")
    return found[1].lower() if found else ""


def rank_of(name: str, attributes: str, within: int) -> int:
    """The rank of an element's text, by its own marks, inside text of the rank ``within``."""
    if within == OUTSIDE or name in OUTSIDE_ELEMENTS or (name == "header" and within < MAIN):
        return OUTSIDE
    role, words = "", set()
    if attributes:
        for key, *values in ATTRIBUTE.findall(attributes):
            value = next(filter(None, values), "")
            if key.lower() == "role":
                role = value.strip().lower()
            else:
                words.update(NAME_PARTS.split(CAPITALS.sub(" ", value).lower()))
    if name not in ("html", "body", "main") and role != "main":
        if role in OUTSIDE_ROLES or not words.isdisjoint(OUTSIDE_WORDS) and not (name == "article" and words.isdisjoint({"comment", "comments"})):
            return OUTSIDE
        if within < MAIN and name != "article" and not words.isdisjoint(PAGE_ONLY_WORDS) and words.isdisjoint(CONTENT_WORDS):
            return OUTSIDE
    if name == "article" or role == "article":
        return ARTICLE
    if name == "main" or role == "main":
        return max(within, MAIN)
    if name not in INLINE and name not in ("html", "body") and not words.isdisjoint(CONTENT_WORDS):
        return max(within, NAMED)
    return within


def blocks(page: str) -> list[tuple[int, str]]:
    """(rank, text) of the page's blocks in order, white space inside a block made one space."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    still_open: dict[str, int] = {}
    rank, at = UNDECIDED, 0

    def end_block() -> None:
        if parts:
            if text := " ".join("".join(parts).split()):
                out.append((rank, text))
            parts.clear()

    def close(name: str) -> None:
        nonlocal rank
        end_block()
        while stack:
            top, before = stack.pop()
            still_open[top] -= 1
            rank = before
            if top == name:
                break

    while True:
        tag = TAG.search(page, at)
        upto = tag.start() if tag else len(page)
        if upto > at:
            parts.append(html.unescape(page[at:upto]))
        if tag is None:
            break
        at = tag.end()
        if tag[2] is None:
            continue
        name = tag[2].lower()
        if tag[1]:
            if still_open.get(name):
                close(name)
            elif name not in INLINE and name not in RAW:
                end_block()
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
            continue
        if name in VOID:
            if name == "br":
                parts.append(" ")
            elif name == "hr":
                end_block()
            continue
        inner = rank_of(name, tag[3], rank)
        if name in INLINE:
            if inner == rank:
                continue
        else:
            end_block()
            if stack and stack[-1][0] == "p":
                close("p")
                inner = rank_of(name, tag[3], rank)
            if name in IMPLIED:
                ended, bound = IMPLIED[name]
                for top, _ in reversed(stack):
                    if top in bound:
                        break
                    if top in ended:
                        close(top)
                        inner = rank_of(name, tag[3], rank)
                        break
        end_block()
        stack.append((name, rank))
        still_open[name] = still_open.get(name, 0) + 1
        rank = inner
    end_block()
    return out


def read_page(page: str | None) -> tuple[str | None, list[str], list[int]]:
    """(text, words of the stream, sizes): the text is the markup's, None where only the host can decide; sizes has the words of each block, times 8, plus its rank."""
    found = blocks(page) if page else []
    best = max((rank for rank, _ in found), default=OUTSIDE)
    text = None if best == UNDECIDED else " ".join(text for rank, text in found if rank == best > UNDECIDED)
    return text, [w for _, text in found for w in text.split(" ")], [8 * (text.count(" ") + 1) + rank for rank, text in found]


def kept(sizes: list[int], covered: np.ndarray) -> np.ndarray:
    """Which words of a stream are the page's text, by what repeated runs cover and by the ranks of its blocks."""
    ranks, lengths = np.array(sizes, np.int64) % 8, np.array(sizes, np.int64) // 8
    best = ranks.max(initial=OUTSIDE)
    if best != UNDECIDED:
        return np.repeat((ranks == best) & (best > UNDECIDED), lengths)
    keep = np.zeros(len(covered), bool)
    at = 0
    for rank, length in zip(ranks.tolist(), lengths.tolist(), strict=True):
        own = slice(at, at := at + length)
        if rank == UNDECIDED and not covered[own].all():
            keep[own] = unique_runs(covered[own])
    return keep


def unique_runs(covered: np.ndarray) -> np.ndarray:
    """A block's words without covered runs of ``RUN`` words or more."""
    edges = np.flatnonzero(np.diff(covered, prepend=~covered[:1], append=~covered[-1:]))
    lengths = np.diff(edges)
    return np.repeat(~covered[edges[:-1]] | (lengths < RUN), lengths)


BLOCKED = "block long, page_id long, url string, sizes array<int>, stream_id binary, n_bytes long, stream binary"


def host_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pages' streams, compressed, each with the block that it falls into: ``BLOCK_WORDS`` words, or as many times 16 bytes, or pages."""
    import xxhash
    from pyspark import TaskContext

    block, size = TaskContext.get().partitionId() << 24, 0
    zstd = pa.Codec("zstd", 3)
    for batch in batches:
        for part in common.slices(batch, SLICE_BYTES, "html"):
            of_block, sizes, ids, lengths, streams = [], [], [], [], []
            for url, page in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True):
                _, words, own = read_page(page)
                if size >= BLOCK_WORDS:
                    block, size = block + 1, 0
                raw = " ".join(words).encode()
                size += 1 + max(len(words), len(raw) // 16)
                of_block.append(block)
                sizes.append(own)
                ids.append(xxhash.xxh3_128_digest(host_of(url).encode() + b"\n" + raw))
                lengths.append(len(raw))
                streams.append(zstd.compress(raw, asbytes=True))
            columns = [
                pa.array(of_block, pa.int64()), part.column("page_id"), part.column("url"), pa.array(sizes, pa.list_(pa.int32())),
                pa.array(ids, pa.binary()), pa.array(lengths, pa.int64()), pa.array(streams, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in BLOCKED.split(", ")])


def pack(ordered: np.ndarray) -> bytes:
    """Sorted numbers as the compressed byte planes of their steps."""
    steps = np.diff(ordered, prepend=np.zeros(1, np.uint64))
    return pa.Codec("zstd", 3).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), asbytes=True)


def unpack(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(packed, 8 * n, asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64)[:, 0], dtype=np.uint64)


def word_hashes(words: list[str]) -> np.ndarray:
    """Two unsigned 64-bit hashes of each word."""
    import xxhash

    raw = b"".join(xxhash.xxh3_128_digest(w.encode()) for w in words)
    return np.frombuffer(raw, np.uint64).reshape(-1, 2)


class Streams:
    """The concatenated streams of a block as numbers."""

    FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)

    def __init__(self, rows: pa.Table):
        zstd = pa.Codec("zstd")
        packed = zip(rows.column("stream").to_pylist(), rows.column("n_bytes").to_pylist(), strict=True)
        self.texts = [zstd.decompress(s, n, asbytes=True).decode() if n else "" for s, n in packed]
        self.ids = rows.column("stream_id").to_pylist()
        split = pc.split_pattern(pa.array([t or None for t in self.texts], pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        self.words = coded.indices.to_numpy().astype(np.int64)
        self.of_word = word_hashes(coded.dictionary.to_pylist())
        lengths = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.ends = np.cumsum(lengths)
        self.page = np.repeat(np.arange(len(lengths)), lengths)
        hosts = pa.array([host_of(u) for u in rows.column("url").to_pylist()], pa.string()).dictionary_encode()
        self.host = hosts.indices.to_numpy().astype(np.int64)
        self.of_host = word_hashes(hosts.dictionary.to_pylist())
        # A suffix shorter than RUN is its page's own: it is left out.
        at = np.arange(len(self.words))
        self.starts = at[self.ends[self.page] - at >= RUN] if len(at) else at

    def first_of(self, owned: set[bytes] | None = None) -> np.ndarray:
        """For each page whether its stream counts: it is the block's first such stream, and among ``owned`` if that is given."""
        seen: set[bytes] = set()
        return np.array([(owned is None or i in owned) and i not in seen and not seen.add(i) for i in self.ids], bool)

    def hashes(self, at: np.ndarray, width: int, kind: int) -> np.ndarray:
        """The hash, of two, of the host and the ``width`` words at each place."""
        of_word, factor = np.ascontiguousarray(self.of_word[:, kind]), self.FACTORS[kind]
        out = self.of_host[self.host[self.page[at]], kind]
        for k in range(width):
            out = out * factor + of_word[self.words[at + k]]
        return out

    def run_hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.hashes(at, RUN, 0), (self.hashes(at, RUN, 1) >> np.uint64(48)).astype(np.uint16)

    def least_grams(self) -> np.ndarray:
        """For each start the least hash of its run's parts of ``GRAM`` words."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        grams = self.hashes(np.arange(len(self.words) - GRAM + 1), GRAM, 0)
        least = grams[self.starts]
        for k in range(1, RUN - GRAM + 1):
            np.minimum(least, grams[self.starts + k], out=least)
        return (least * self.FACTORS[1]) >> np.uint64(64 - GRAM_BITS)

    def suffix_array(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``starts`` by host and ``RUN`` words, sorted by doubling, and where each substring begins among them."""
        need = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(need, starts, 1)
        np.add.at(need, starts + RUN, -1)
        at = np.flatnonzero(np.cumsum(need)[:-1])
        rank = np.unique(self.words[at], return_inverse=True)[1]
        for step in (1, 2, 4):
            pairs = rank * np.int64(len(rank) + 1) + np.append(rank[step:], np.zeros(min(step, len(rank)), np.int64))
            rank = np.unique(pairs, return_inverse=True)[1]
        rank = rank[np.searchsorted(at, starts)]
        host = self.host[self.page[starts]]
        order = np.lexsort((rank, host))
        rank, host = rank[order], host[order]
        new = np.append(True, (rank[1:] != rank[:-1]) | (host[1:] != host[:-1]))
        return starts[order], np.flatnonzero(new)


COUNTED = "part int, block long, n long, g1 binary, g2 binary, counts binary, streams binary"
FOUND = "of_block long, n long, g1 binary, g2 binary, streams binary"


def dealt(block: int, g1: np.ndarray, g2: np.ndarray, counts: np.ndarray, ids: list[bytes], bits: int, top: int) -> pa.Table:
    """Rows of a block's sorted hashes of ``top`` bits, and of its stream ids, by their first ``bits``."""
    cuts = np.append(np.searchsorted(g1, np.arange(1 << bits, dtype=np.uint64) << np.uint64(top - bits)) if bits else np.zeros(1, int), len(g1))
    own: dict[int, list[bytes]] = {}
    for i in ids:
        own.setdefault(int.from_bytes(i[:4], "big") >> (32 - bits), []).append(i)
    rows = []
    for part, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if hi > lo or part in own:
            rows.append((part, block, hi - lo, pack(g1[lo:hi]), g2[lo:hi].tobytes(), counts[lo:hi].tobytes(), b"".join(own.get(part, ()))))
    return table_of(rows, COUNTED)


def table_of(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.table({name: pa.array(list(c), kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


def hashes_in(rows: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The hashes of each row; the second part is empty for grams."""
    firsts = [unpack(p, n) for p, n in zip(rows.column("g1").to_pylist(), rows.column("n").to_pylist(), strict=True)]
    return firsts, [np.frombuffer(p, np.uint16) for p in rows.column("g2").to_pylist()]


def repeated(rows: pa.Table) -> pa.Table:
    """One part of all blocks: each block gets back its hashes that stand in ``PAGES`` streams or more, and the stream ids that it is the first to have."""
    rows = rows.sort_by("block")
    firsts, seconds = hashes_in(rows)
    g1, g2 = np.concatenate(firsts), np.concatenate(seconds)
    counts = np.concatenate([np.frombuffer(p, np.uint8) for p in rows.column("counts").to_pylist()])
    order = np.lexsort((g2, g1)) if len(g2) else np.argsort(g1)
    new = np.ones(len(g1), bool)
    new[1:] = g1[order][1:] != g1[order][:-1]
    if len(g2):
        new[1:] |= g2[order][1:] != g2[order][:-1]
    group = np.cumsum(new) - 1
    frequent = np.empty(len(g1), bool)
    frequent[order] = (np.bincount(group, counts[order]) >= PAGES)[group] if len(g1) else False
    out, seen, at = [], set(), 0
    for block, own1, own2, ids in zip(rows.column("block").to_pylist(), firsts, seconds, rows.column("streams").to_pylist(), strict=True):
        hit = frequent[at : at + len(own1)]
        at += len(own1)
        own = [i for k in range(0, len(ids), 16) if (i := ids[k : k + 16]) not in seen]
        seen.update(own)
        if hit.any() or own:
            out.append((block, int(hit.sum()), pack(own1[hit]), own2[hit].tobytes() if len(own2) else b"", b"".join(own)))
    return table_of(out, FOUND)


def gram_counts(rows: pa.Table, bits: int) -> pa.Table:
    """A block's least grams with the number of its streams that have them."""
    streams = Streams(rows)
    first = streams.first_of()
    page = streams.page[streams.starts]
    grams = streams.least_grams()[first[page]] << np.uint64(64 - GRAM_BITS)
    by_page = np.unique(grams | page[first[page]].astype(np.uint64)) >> np.uint64(64 - GRAM_BITS)
    g1, counts = np.unique(by_page, return_counts=True)
    ids = [i for i, counted in zip(streams.ids, first, strict=True) if counted]
    return dealt(rows.column("block")[0].as_py(), g1, np.zeros(0, np.uint16), np.minimum(counts, PAGES).astype(np.uint8), ids, bits, GRAM_BITS)


def run_counts(rows: pa.Table, grams: pa.Table, bits: int) -> pa.Table:
    """A block's substrings that may be repeated, from its suffix array, with the number of its streams that have them."""
    if not rows.num_rows or not grams.num_rows:
        return table_of([], COUNTED)
    streams = Streams(rows)
    starts = streams.starts[np.isin(streams.least_grams(), np.concatenate(hashes_in(grams)[0]))]
    if not len(starts):
        return table_of([], COUNTED)
    ids = b"".join(grams.column("streams").to_pylist())
    counted = streams.first_of({ids[k : k + 16] for k in range(0, len(ids), 16)})
    array, first = streams.suffix_array(starts)
    page = streams.page[array]
    new = np.append(True, page[1:] != page[:-1])
    new[first] = True
    counts = np.minimum(np.add.reduceat((new & counted[page]).astype(np.int64), first), PAGES).astype(np.uint8)
    g1, g2 = streams.run_hashes(array[first])
    order = np.argsort(g1)
    return dealt(rows.column("block")[0].as_py(), g1[order], g2[order], counts[order], [], bits, 64)


TEXTS = "page_id long, url string, text string, n_repeated long"


def texts(rows: pa.Table, runs: pa.Table) -> pa.Table:
    """The texts of a block's pages, cut from their streams by what the repeated ``runs`` cover."""
    if not rows.num_rows:
        return table_of([], TEXTS)
    streams = Streams(rows)
    marks = np.zeros(len(streams.words) + 1, np.int64)
    if runs.num_rows and len(streams.starts):
        firsts, seconds = (np.concatenate(g) for g in hashes_in(runs))
        pairs = set(zip(firsts.tolist(), seconds.tolist(), strict=True))
        g1, g2 = streams.run_hashes(streams.starts)
        maybe = np.flatnonzero(np.isin(g1, firsts))
        hit = [pair in pairs for pair in zip(g1[maybe].tolist(), g2[maybe].tolist(), strict=True)]
        starts = streams.starts[maybe[np.array(hit, bool)]]
        np.add.at(marks, starts, 1)
        np.add.at(marks, starts + RUN, -1)
    covered = np.cumsum(marks)[:-1] > 0
    out, repeats, at = [], [], 0
    for text, end, sizes in zip(streams.texts, streams.ends.tolist(), rows.column("sizes").to_pylist(), strict=True):
        own = covered[at:end]
        keep = kept(sizes, own)
        out.append(" ".join(compress(text.split(" "), keep.tolist())))
        repeats.append(int((keep & own).sum()))
        at = end
    return pa.table({"page_id": rows.column("page_id"), "url": rows.column("url"), "text": pa.array(out, pa.string()), "n_repeated": pa.array(repeats, pa.int64())})


def extract(pages: DataFrame, repeats: bool = False) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``; with ``repeats`` also n_repeated, the words of the text in runs that its host repeats."""
    common.ship(pages.sparkSession)
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    size = source.agg(F.sum(F.octet_length("html").cast("long"))).first()[0] or 0
    bits = max(0, -(-size // RANGE_BYTES) - 1).bit_length()
    # The one shuffle of the streams serves all three passes over the blocks.
    streams = source.mapInArrow(common.tidy(host_blocks), BLOCKED)

    def count_grams(rows: pa.Table) -> pa.Table:
        return gram_counts(rows, bits)

    def count_runs(rows: pa.Table, found: pa.Table) -> pa.Table:
        return run_counts(rows, found, bits)

    grams = streams.groupBy("block").applyInArrow(count_grams, COUNTED).groupBy("part").applyInArrow(repeated, FOUND)
    runs = streams.groupBy("block").cogroup(grams.groupBy("of_block")).applyInArrow(count_runs, COUNTED).groupBy("part").applyInArrow(repeated, FOUND)
    found = streams.groupBy("block").cogroup(runs.groupBy("of_block")).applyInArrow(texts, TEXTS)
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), *(["n_repeated"] if repeats else []))
