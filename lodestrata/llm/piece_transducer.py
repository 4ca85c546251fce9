"""Operator 6: SentencePiece encoding and decoding by a weighted finite-state transducer.

Three machines are compiled from a model file and composed with each input:

* the *normaliser* rewrites the longest matching key of the model's character map,
  puts a word-start mark before the text and turns spaces into it;
* the *lexicon* reads a piece's characters and writes its id;
* *byte fallback* reads a character that no piece covers and writes its UTF-8 bytes' ids.

Weights live in the tropical semiring and the answer is the shortest path, found by
relaxing the composition's arcs from left to right. For a unigram model an arc costs
minus the piece's log probability and the state is the position. For a BPE model the
state also holds the last piece written. An arc costs one, or infinity where merging
would join the two pieces: each piece is compiled to the parts along its left and its
right edge, with the score at which the merge order absorbs each of them. Two
neighbouring parts would merge if their union is a piece that comes before the merges
that absorb either. A path of finite weight then is one whose neighbours all stay
apart, which is the merge result, for every prefix as well.

No piece holds a word-start mark after another character (checked when the
model is compiled), so each path passes through every word boundary and words
are composed one by one, each distinct word once, kept in two generations
bounded in bytes; the same holds between any two characters that no piece holds
side by side. Decoding writes the pieces' bytes and undoes the marks.

Defined cases: a null or empty text has no ids and decodes to the empty text;
a text with the mark itself decodes to a space there; decoding gives the
normalised text, so ``round_trip`` compares with that; where no path is finite each
character goes to byte fallback; repeated rows and ids are each encoded; very long
texts are encoded whole; an empty table gives no rows; columns other than those
named are passed on untouched, and added columns take a free name. Models with
user-defined symbols are refused.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
CACHE_BYTES = 32 << 20
STABLE_BYTES = 12 << 20
WALKED = 1 << 12
SHORT = 24
SLICE_BYTES = 1 << 20
RUNS = re.compile(f"{MARK}+[^{MARK}]*")
INFINITE = float("inf")


class Normaliser:
    """The rewriting machine of a model: longest keys of its character map, then white space."""

    def __init__(self, spec, suffix: bool):
        self.prefix, self.squeeze, self.escape, self.suffix = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, suffix
        raw = spec.precompiled_charsmap
        size = int.from_bytes(raw[:4], "little") if raw else 0
        self.units = np.frombuffer(raw, "<u4", size // 4, 4).tolist() if size else []
        self.values = raw[4 + size :]
        self.known: dict[str, tuple[int, str] | None] = {}

    def _longest(self, key: bytes) -> tuple[int, str] | None:
        """(bytes read, replacement) of the longest key that ``key`` starts with, from the double array."""
        units, found = self.units, None
        at = units[0] >> 10 << ((units[0] & 512) >> 6)
        for i, byte in enumerate(key):
            unit = units[at ^ byte]
            if unit & 0x800000FF != byte:
                break
            at = at ^ byte ^ (unit >> 10 << ((unit & 512) >> 6))
            if unit & 256:
                start = units[at] & 0x7FFFFFFF
                found = i + 1, self.values[start : self.values.index(0, start)].decode()
        return found

    def rewrite(self, text: str) -> str:
        """``text`` with every longest key replaced; other characters are read as they are."""
        if not self.units:
            return text
        out, at, n = [], 0, len(text)
        while at < n:
            window = text[at : at + 24]
            found = self.known.get(window, self)
            if found is self:
                hit = self._longest(window.encode("utf-8", "replace"))
                found = hit and (len(window.encode("utf-8", "replace")[: hit[0]].decode()), hit[1])
                if len(self.known) >= 4096:
                    self.known.clear()
                self.known[window] = found
            if found:
                out.append(found[1])
                at += found[0]
            else:
                out.append(text[at])
                at += 1
        return "".join(out)

    def __call__(self, text: str) -> str:
        space = MARK if self.escape else " "
        plain = self.rewrite(text)
        if self.squeeze:
            plain = re.sub(" +", " ", plain).strip(" ")
        if not plain:
            return ""
        plain = plain.replace(" ", space)
        if self.prefix:
            plain = plain + space if self.suffix else space + plain
        return plain


class Transducer:
    """The composed machine of one model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kinds = pb.ModelProto.SentencePiece
        if proto.trainer_spec.model_type not in (1, 2) or any(p.type == kinds.USER_DEFINED for p in proto.pieces):
            raise ValueError("only unigram and BPE models without user-defined symbols are compiled")
        self.normalise = Normaliser(proto.normalizer_spec, proto.trainer_spec.treat_whitespace_as_suffix)
        self.unigram = proto.trainer_spec.model_type == 1
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_id = [-1] * 256
        self.piece_bytes: list[bytes] = [b""] * len(proto.pieces)
        self.unknown = 0
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = i
                self.piece_bytes[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == kinds.UNKNOWN:
                self.unknown = i
                self.piece_bytes[i] = proto.trainer_spec.unk_surface.encode()
            elif p.type == kinds.NORMAL:
                self.ids[p.piece] = i
                self.score[p.piece] = p.score
                self.piece_bytes[i] = p.piece.replace(MARK, " ").encode()
        self.fallback = proto.trainer_spec.byte_fallback and self.byte_id[0] >= 0
        self.unknown_cost = 10.0 - min(self.score.values(), default=0.0)
        self.joined = {pair for p in self.ids for pair in zip(p, p[1:], strict=False)}
        self.by_word = not any(MARK in p.lstrip(MARK) for p in self.ids)
        # Lexicon: a node for every prefix of a piece; under "" the piece that ends there.
        self.lexicon: dict = {}
        for piece in self.ids:
            node = self.lexicon
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = piece
        # A piece's edges are compiled when it is first met: None before, empty if merging never gives the piece.
        self.left: dict[str, list[tuple[str, float]] | None] = dict.fromkeys(self.ids)
        self.right: dict[str, list[tuple[str, float]] | None] = dict.fromkeys(self.ids)
        self.stable: dict[str, dict[str, bool | str]] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = self.stable_held = 0
        self.coded: dict[str, bytes] = {}
        self._forget_walk()

    def _edges(self, piece: str) -> None:
        """Compiles a piece's left and right edges from its merges; they are empty if merging never gives the piece."""
        score = self.score
        parts = [(c, [(c, -INFINITE)], [(c, -INFINITE)]) for c in piece]
        while len(parts) > 1:
            best, at = -INFINITE, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i][0] + parts[i + 1][0])
                if s is not None and s > best:
                    best, at = s, i
            if at < 0:
                self.left[piece] = self.right[piece] = []
                return
            (x, x_left, _), (y, _, y_right) = parts[at : at + 2]
            own = (x + y, -INFINITE)
            parts[at : at + 2] = [(x + y, [own, (x, best), *x_left[1:]], [own, (y, best), *y_right[1:]])]
        self.left[piece], self.right[piece] = parts[0][1], parts[0][2]

    def made(self, piece: str) -> bool:
        """Whether merging can give ``piece``; a character always stands for itself."""
        if self.left.get(piece, self) is None:
            self._edges(piece)
        return self.left.get(piece) != []

    def apart(self, last: str, piece: str) -> bool:
        """Whether merging leaves ``last`` and ``piece`` side by side: no two parts at their border join first."""
        if not (self.made(last) and self.made(piece)):
            return False
        score = self.score
        near = self.left.get(piece) or [(piece, -INFINITE)]
        for r, r_until in self.right.get(last) or [(last, -INFINITE)]:
            for l, l_until in near:
                s = score.get(r + l)
                # Of equal scores the leftmost pair merges first.
                if s is not None and s > r_until and s >= l_until:
                    return False
        return True

    def weight(self, last: str, piece: str) -> float:
        """Weight of the arc that writes ``piece`` in the state ``last``."""
        if self.unigram:
            s = self.score.get(piece)
            return self.unknown_cost if s is None else -s
        if not last:
            return 1.0 if self.made(piece) else INFINITE
        known = self.stable.get(last)
        if known is None:
            known = self.stable[last] = {"": last}
        ok = known.get(piece)
        if ok is None:
            ok = known[piece] = self.apart(last, piece)
            self.stable_held += 100
        return 1.0 if ok else INFINITE

    def _arcs(self, text: str, at: int) -> list[str]:
        """The pieces that start at ``at``, short to long; a character without a piece is an arc to byte fallback."""
        node = self.lexicon.get(text[at])
        out = [text[at]]
        for c in text[at + 1 :]:
            node = node and node.get(c)
            if not node:
                break
            if (piece := node.get("")) is not None:
                out.append(piece)
        return out

    def shortest_path(self, text: str) -> list[str]:
        """Pieces of the path of least weight through ``text`` (already normalised); unknown characters stand alone."""
        return (None if self.unigram else self._only_path(text)) or self._least_path(text)

    def _step(self, node: dict, c: str) -> dict:
        """The lexicon's node for the longest end of what was read, ``c`` included, that a piece begins with."""
        while (to := node.get(c)) is None:
            if node is self.lexicon:
                return node
            node = node["shorter"]
        if "ending" not in to:
            to["shorter"] = shorter = self.lexicon if node is self.lexicon else self._step(node["shorter"], c)
            own = to.get("")
            ending = ((own, len(own)),) if own is not None else ()
            ending += shorter.get("ending", ())
            to["ending"] = ending if ending and ending[-1][1] == 1 else (*ending, (c, 1))
        return to

    def _only_path(self, text: str) -> list[str] | None:
        """The relaxation for BPE, where one state of finite weight at most reaches a position; None if none reaches the end.

        Every path of finite weight is the merge result of what it read, so once one reaches a position all other arcs
        that end there have infinite weight. A position is relaxed from the arcs that end there: what reaches it
        depends on the text before it alone, and a text goes on where it parts from the one before.
        """
        before, nodes, reached = self.walked
        stable, root = self.stable, self.lexicon
        end = 0
        for end, (x, y) in enumerate(zip(before, text, strict=False)):  # noqa: B007
            if x != y:
                break
        else:
            end = min(len(before), len(text))
        del nodes[end + 1 :], reached[end + 1 :]
        node = nodes[end]
        for c in text[end:]:
            end += 1
            to = node.get(c)
            node = to if to is not None and "ending" in to else self._step(node, c)
            found = None
            for piece, size in ((c, 1),) if node is root else node["ending"]:
                known = reached[end - size]
                if known is None:
                    continue
                ok = known.get(piece)
                if ok is None:
                    last = known[""]
                    ok = known[piece] = self.apart(last, piece) if last else self.made(piece)
                    self.stable_held += 100
                if ok:
                    found = piece
                    break
            nodes.append(node)
            if found is None:
                reached.append(None)
            else:
                reached.append(stable.get(found) or stable.setdefault(found, {"": found}))
        out, at = [], len(text)
        while at:
            known = reached[at]
            if known is None:
                break
            piece = known[""]
            out.append(piece)
            at -= len(piece)
        if len(text) > WALKED:
            self._forget_walk()
        else:
            self.walked = text, nodes, reached
        return None if at else out[::-1]

    def _forget_walk(self) -> None:
        # Of each position: the lexicon's node, and the state's known borders with the piece itself under "".
        self.walked = "", [self.lexicon], [self.stable.setdefault("", {"": ""})]

    def _least_path(self, text: str) -> list[str]:
        n, weight, unigram = len(text), self.weight, self.unigram
        # Per position the live states: last piece -> (cost, piece on the arc, state before).
        live: list[dict[str, tuple[float, str, str]]] = [{} for _ in range(n + 1)]
        live[0][""] = (0.0, "", "")
        for at in range(n):
            if not live[at]:
                continue
            arcs = self._arcs(text, at)
            for last, (cost, _, _) in live[at].items():
                for piece in arcs:
                    total = cost + weight(last, piece)
                    if total == INFINITE:
                        continue
                    reached, state = live[at + len(piece)], "" if unigram else piece
                    old = reached.get(state)
                    if old is None or total < old[0]:
                        reached[state] = (total, piece, last)
        if not live[n]:
            return list(text)
        state = min(live[n], key=lambda k: live[n][k][0])
        out = []
        while n:
            _, piece, before = live[n][state]
            out.append(piece)
            n -= len(piece)
            state = before
        return out[::-1]

    def cuts(self, text: str) -> list[str]:
        """``text`` cut wherever no piece holds the two characters side by side: every path passes there."""
        joined = self.joined
        if not self.fallback or all(map(joined.__contains__, zip(text, text[1:], strict=False))):
            return [text]
        out, at = [], 0
        for i, pair in enumerate(zip(text, text[1:], strict=False), 1):
            if pair not in joined:
                out.append(text[at:i])
                at = i
        out.append(text[at:])
        return out

    def _ids(self, text: str) -> bytes:
        parts = self.cuts(text) if len(text) > SHORT or self.unigram else ()
        if len(parts) > 1:
            self._learn(sorted(part for part in set(parts) if part not in self.words))
            return b"".join([self.words[part] for part in parts])
        pieces = self.shortest_path(text)
        try:
            return b"".join([self.coded[piece] for piece in pieces])
        except KeyError:
            self.coded.update({p: self.ids[p].to_bytes(4, "little") for p in pieces if p in self.ids})
        out: list[int] = []
        for piece in pieces:
            i = self.ids.get(piece)
            if i is not None:
                out.append(i)
            elif self.fallback:
                out.extend(self.byte_id[b] for b in piece.encode())
            elif not out or out[-1] != self.unknown:  # a run of unknown characters is one id
                out.append(self.unknown)
        return np.array(out, "<i4").tobytes()

    def _learn(self, words: list[str]) -> None:
        for w in words:
            ids = self.older.get(w)
            self.words[w] = ids = self._ids(w) if ids is None else ids
            self.held += 2 * len(w) + len(ids) + 200

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of every whole text."""
        if self.held > CACHE_BYTES:  # before the lookups below, which count on what stays
            self.words, self.older, self.held = {}, self.words, 0
        if self.stable_held > STABLE_BYTES:
            self.stable, self.stable_held = {}, 0
            self._forget_walk()
        split = []
        for text in texts:
            marked = self.normalise(text) if text else ""
            split.append(RUNS.findall(marked) if self.by_word and marked[:1] == MARK else [marked] if marked else [])
        needed = set().union(*split) if split else set()
        self._learn(sorted(w for w in needed if w not in self.words))
        get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.piece_bytes.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        if self.normalise.prefix:
            raw = raw[:-1] if self.normalise.suffix and raw[-1:] == b" " else raw[1:] if raw[:1] == b" " else raw
        return raw.decode("utf-8", "replace")

    def plain(self, text: str | None) -> str:
        """What decoding gives back of ``text``: its normal form without marks."""
        t = self.normalise.rewrite(text or "").replace(MARK, " ")
        return re.sub(" +", " ", t).strip(" ") if self.normalise.squeeze else t


def encode(docs: DataFrame, model: str) -> DataFrame:
    """All columns of ``docs`` and ids array<int>, n_tokens, n_fallback, ids_crc32, decoded_crc32, round_trip.

    Each task compiles the machine (about a second) and drops it with the words it learned when its rows end, so
    that idle workers hold nothing.
    """
    common.ship(docs.sparkSession)
    added = {
        "ids": "array<int>",
        "n_tokens": "bigint",
        "n_fallback": "bigint",
        "ids_crc32": "bigint",
        "decoded_crc32": "bigint",
        "round_trip": "boolean",
    }
    names = [common.free_name(docs, n) for n in added]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"{n} {t}" for n, t in zip(names, added.values(), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer(model)
        is_byte = np.zeros(len(machine.piece_bytes), bool)
        is_byte[[b for b in machine.byte_id if b >= 0]] = True
        for whole in batches:
            for batch in common.slices(whole, SLICE_BYTES):
                texts = batch.column("text").to_pylist()
                coded = machine.encode(texts)
                decoded = [machine.decode(c) for c in coded]
                flat = np.frombuffer(b"".join(coded), "<i4")
                counts = np.array([len(c) // 4 for c in coded], np.int64)
                ends = np.concatenate([[0], np.cumsum(counts)])
                fallback = np.concatenate([[0], np.cumsum(is_byte[flat])])
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns,
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32))),
                        pa.array(counts),
                        pa.array(fallback[ends[1:]] - fallback[ends[:-1]]),
                        pa.array([zlib.crc32(c) for c in coded], pa.int64()),
                        pa.array([zlib.crc32(t.encode("utf-8", "replace")) for t in decoded], pa.int64()),
                        pa.array([a == machine.plain(b) for a, b in zip(decoded, texts, strict=True)], pa.bool_()),
                    ],
                    [*batch.schema.names, *names],
                )

    return docs.mapInArrow(common.tidy(run), schema)


def sentencepiece(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, n_tokens, n_fallback, ids_crc32, decoded_crc32, round_trip for every row."""
    return encode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).drop("text")
