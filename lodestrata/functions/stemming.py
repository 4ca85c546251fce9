"""The public English (Porter 2) stemmer, in steps of SQL that Spark runs inside its own generated code.

A step is a CASE over the word ``w`` and the starts ``r1`` and ``r2`` of its two regions. The text
holds for Spark and for DuckDB but for two functions, which a dialect names.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The public stop words of English full-text search.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()

VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
#: A syllable is short if it ends so, or is a vowel and another letter alone.
SHORT = f"({OTHER}{VOWEL}[^aeiouywxY]|^{VOWEL}{OTHER})$"

#: Whole words with a stem of their own.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")


class Dialect(NamedTuple):
    matches: str
    group: str
    everywhere: str

    def replace(self, pattern: str, by: str) -> str:
        return f"regexp_replace(w, '{pattern}', '{by.format(g=self.group)}'{self.everywhere})"

    def like(self, text: str, pattern: str) -> str:
        return f"{self.matches}({text}, '{pattern}')"


SPARK = Dialect("regexp_like", "$1", "")
DUCKDB = Dialect("regexp_matches", "\\1", ", 'g'")


def _cut(n: int) -> str:
    return f"left(w, length(w) - {n})"


def _longest(rules: list[tuple[str, str | None, str]]) -> str:
    """The longest of the suffixes that the word ends in decides: (suffix, replacement or None, condition)."""
    cases = []
    for suffix, by, condition in sorted(rules, key=lambda r: -len(r[0])):
        then = "w" if by is None else f"CASE WHEN {condition} THEN {_cut(len(suffix))} || '{by}' ELSE w END"
        cases.append(f"WHEN w LIKE '%{suffix}' THEN {then}")
    return f"CASE {' '.join(cases)} ELSE w END"


def _within(region: str, suffix: str) -> str:
    return f"length(w) - {len(suffix)} >= {region}"


def _all(region: str, pairs: str, condition: str = "") -> list[tuple[str, str | None, str]]:
    """'suffix:replacement ...', each in ``region``."""
    out = []
    for pair in pairs.split():
        suffix, _, by = pair.partition(":")
        out.append((suffix, by, _within(region, suffix) + (f" AND {condition}" if condition else "")))
    return out


def steps(d: Dialect) -> list[dict[str, str]]:
    """The columns to set, step by step, on a word in lower case."""
    r1 = f"CASE WHEN {d.like('w', '^(gener|arsen)')} THEN 5 WHEN {d.like('w', '^commun')} THEN 6 ELSE coalesce(nullif(length(regexp_extract(w, '^{OTHER}*{VOWEL}+{OTHER}', 0)), 0), length(w)) END"
    r2 = f"r1 + coalesce(nullif(length(regexp_extract(substring(w, r1 + 1), '^{OTHER}*{VOWEL}+{OTHER}', 0)), 0), greatest(length(w) - r1, 0))"
    removed = {s: _cut(len(s)) for s in ("ed", "edly", "ing", "ingly")}
    one_b = "CASE " + " ".join(
        [f"WHEN w LIKE '%{s}' THEN CASE WHEN {_within('r1', s)} THEN {_cut(len(s))} || 'ee' ELSE w END" for s in ("eedly", "eed")]
        + [f"WHEN w LIKE '%{s}' AND {d.like(removed[s], VOWEL)} THEN {removed[s]} || '+' " for s in ("ingly", "edly", "ing", "ed")]
    ) + " ELSE w END"
    bare = _cut(1)
    mended = (
        f"CASE WHEN w NOT LIKE '%+' THEN w WHEN {d.like(bare, '(at|bl|iz)$')} THEN {bare} || 'e' "
        f"WHEN {d.like(bare, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$')} THEN {_cut(2)} "
        f"WHEN length({bare}) <= r1 AND {d.like(bare, SHORT)} THEN {bare} || 'e' ELSE {bare} END"
    )
    one_a = (
        f"CASE WHEN w LIKE '%sses' THEN {_cut(2)} WHEN w LIKE '%ied' OR w LIKE '%ies' THEN CASE WHEN length(w) > 4 THEN {_cut(2)} ELSE {_cut(1)} END "
        f"WHEN w LIKE '%us' OR w LIKE '%ss' THEN w WHEN w LIKE '%s' AND {d.like(_cut(2), VOWEL)} THEN {_cut(1)} ELSE w END"
    )
    two = _all("r1", "tional:tion enci:ence anci:ance abli:able entli:ent izer:ize ization:ize ational:ate ation:ate ator:ate alism:al aliti:al alli:al fulness:ful ousli:ous ousness:ous iveness:ive iviti:ive biliti:ble bli:ble fulli:ful lessli:less")
    two += [("ogi", "og", f"{_within('r1', 'ogi')} AND w LIKE '%logi'"), ("li", "", f"{_within('r1', 'li')} AND {d.like('w', '[cdeghkmnrt]li$')}")]
    three = _all("r1", "tional:tion ational:ate alize:al icate:ic iciti:ic ical:ic ful: ness:") + [("ative", "", _within("r2", "ative"))]
    four = _all("r2", "al: ance: ence: er: ic: able: ible: ant: ement: ment: ent: ism: ate: iti: ous: ive: ize:")
    four += [("ion", "", f"{_within('r2', 'ion')} AND {d.like('w', '[st]ion$')}")]
    five = (
        f"CASE WHEN w LIKE '%e' AND ({_within('r2', 'e')} OR {_within('r1', 'e')} AND NOT {d.like(_cut(1), SHORT)}) THEN {_cut(1)} "
        f"WHEN w LIKE '%ll' AND {_within('r2', 'l')} THEN {_cut(1)} ELSE w END"
    )
    own = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SPECIAL.items())
    kept = ", ".join(f"'{k}'" for k in KEPT)
    held = lambda text: f"CASE WHEN kept THEN w ELSE {text} END"
    return [
        {"own": f"CASE word {own} WHEN word THEN CASE WHEN length(word) < 3 OR {d.like('word', '[^a-z]')} THEN word END END", "w": "word"},
        {"w": d.replace("^y", "Y")},
        {"w": d.replace("([aeiouy])y", "{g}Y")},
        {"r1": r1},
        {"r2": r2},
        {"w": one_a},
        {"kept": f"w IN ({kept})"},
        {"w": held(one_b)},
        {"w": held(mended)},
        {"w": held(f"CASE WHEN {d.like('w', '..*[^aeiouy][yY]$')} THEN {_cut(1)} || 'i' ELSE w END")},
        {"w": held(_longest(two))},
        {"w": held(_longest(three))},
        {"w": held(_longest(four))},
        {"w": held(five)},
        {"stem": "coalesce(own, lower(w))"},
    ]


def stem(words: DataFrame, word: str = "word", name: str = "stem") -> DataFrame:
    """``words`` with the stem of its column ``word``, whose words are in lower case; words with other letters or digits stay."""
    keep = words.columns
    out, fields = words.withColumn("_word", F.col(word)), ["word"]
    for step in steps(SPARK):
        named = {k: _scoped(v, fields) for k, v in step.items()}
        kept = [f"_{f}" for f in fields if f not in step]
        out = out.select(*keep, *kept, *[F.expr(text).alias(f"_{f}") for f, text in named.items()])
        fields += [k for k in step if k not in fields]
    return out.select(*keep, F.col("_stem").alias(name))


def _scoped(text: str, fields: list[str]) -> str:
    """``text`` with its names replaced by the columns that hold them."""
    parts = re.split(r"('[^']*')", text)
    own = re.compile(r"\b(" + "|".join(fields) + r")\b")
    return "".join(part if i % 2 else own.sub(r"_\1", part) for i, part in enumerate(parts))


def stem_sql(source: str, name: str) -> str:
    """Common table expressions for DuckDB that end in ``name`` (word, stem), over the words of ``source``."""
    out, fields, before = [], ["word"], source
    for i, step in enumerate(steps(DUCKDB)):
        kept = [f for f in fields if f not in step]
        fields += [k for k in step if k not in fields]
        current = name if "stem" in step else f"{name}_{i}"
        chosen = ["word", "stem"] if "stem" in step else fields
        columns = [f"{step[f]} AS {f}" if f in step else f for f in chosen if f in step or f in kept]
        out.append(f"{current} AS (SELECT {', '.join(columns)} FROM {before})")
        before = current
    return ",\n".join(out)
