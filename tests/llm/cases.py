"""A table with every awkward row, and helpers for brute force."""

from __future__ import annotations

import re
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, row int, size string, fp string, shard int"
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew potions near old rivers".split()
PROSE = " ".join(WORDS)
LONG = " ".join(f"{w}{i % 37}" for i in range(9000) for w in WORDS[i % 16 : i % 16 + 1])


def lower_ascii(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def space_words(t: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(t or ""))


def item_words(t: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(t or ""))


def fold(doc_id, m: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % m


def rows():
    texts = [
        None, "", " \t\n ", PROSE, PROSE, PROSE + " extra", "Re.", "ÉCOLE éèê Straße", "42 7 ...", LONG, LONG + " end",
        "All rights reserved.\n" + PROSE, "x　y z", "emoji \U0001f600 漢字", "THE QUICK BROWN FOX JUMPS OVER A LAZY DOG", "a" * 5000,
        "tab\tand  double  space \n line", "<|endoftext|> literal", "▁marked▁", "It's don't 'tis 's",
    ]
    out = [(i, t, ("en", "fr", "de", None)[i % 4], f"src{i % 3}", len(t or ""), "clash", 7, "clash", "clash", 3) for i, t in enumerate(texts)]
    out.append(out[3])  # a repeated row
    out.append((None, PROSE, "en", None, None, None, None, None, None, None))
    out.append((5, "same id, another text", None, "src9", 3, None, None, None, None, None))
    return out


def awkward(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(values):
    return sorted(values, key=lambda r: tuple((x is not None, str(x)) for x in r))
