"""Days and magnitudes that a question asks for, by the kinds of its tokens.

A question is cut into numbers, words, signs and gaps, and every token becomes one letter for
its kind. A date or a magnitude is then a short sequence of kinds, looked for in that string, and
the tokens at its place give the values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAMES = "january february march april may june july august september october november december"
#: Every month's name and its first three letters; September also has four.
MONTHS = {form: i for i, name in enumerate(_NAMES.split(), 1) for form in (name, name[:3], *(["sept"] if name[0] == "s" else []))}

#: Kinds of a date's tokens: Y year, N day or month number, x other number, M month, p word that begins with one, o letters
#: that may follow a day's number, f "of", w word, _ gap; signs stand for themselves.
_SHORT_NAME = "|".join(sorted({form[:3] for form in MONTHS}))
_GAP = r"(?:_|_?[-/.]_?)"
_THEN_YEAR = rf"(?:(?:,_?|{_GAP})(Y))?"
_EDGE, _END = r"(?<![NYxMpofw])", r"(?![NYxMpofw])"
#: Sequence of kinds, and the order of its values; the first in this list that occurs decides.
DATES = [
    (rf"{_EDGE}Y-N-N{_END}", "ymd"),
    (rf"{_EDGE}Y{_GAP}M\.?{_GAP}N[of]?{_END}", "ymd"),
    (rf"{_EDGE}M\.?{_GAP}N[of]?{_END}{_THEN_YEAR}", "mdy"),
    (rf"{_EDGE}N[of]?{_GAP}(?:f_)?[Mp]\.?{_THEN_YEAR}", "dmy"),
    (rf"{_EDGE}N/N(?:/Y)?{_END}", "mdy"),
]

#: Kinds of a magnitude's tokens: s more than, c and t "greater than", a and l "at least", i minimum, e article, m
#: magnitude, n number, r "or", u or above, g at least as a sign; the rest as above.
FLOOR_WORDS = {
    "s": ["above", "over", "exceeding"], "c": ["greater", "larger", "bigger", "more"], "t": ["than"], "a": ["at"], "l": ["least"], "i": ["minimum"],
    "e": ["an", "a"], "m": ["magnitude", "mag", "mw", "m"], "r": ["or"], "u": ["higher"],
}
_START = "(?<![a-z])"
#: Sequence of kinds, and whether the number itself is meant too.
FLOORS = [
    (f"{_START}(?:s|c_t)_(?:e_)?m_?n", False),
    (f"{_START}(?:a_l|i)_(?:e_)?m_?n", True),
    (f"{_START}m_?n_?(?:[+]|r_[scu])", True),
    ("g_?(?:m_?)?n", True),
]


def _cut(text: Column, number: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(rf"({number}|\p{{L}}+|\s+|>=|[^\p{{L}}\s])"), 1)


def _kinds(tokens: Column, kind) -> Column:
    return F.array_join(F.transform(tokens, kind), "")


def _with(value: Column, then) -> Column:
    """``then(value)``, the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _date_kind(token: Column) -> Column:
    return (
        F.when(token.rlike("^20[0-9][0-9]$"), "Y").when(token.rlike("^[0-9]{1,2}$"), "N").when(token.rlike("^[0-9]"), "x")
        .when(token.isin(list(MONTHS)), "M").when(token == "of", "f").when(token.rlike(f"^({_SHORT_NAME})"), "p")
        .when(token.rlike("^[a-z]{1,2}$"), "o").when(token.rlike(r"^\p{L}"), "w").when(token.rlike(r"^\s"), "_").otherwise(token)
    )


def _floor_kind(token: Column) -> Column:
    kind = F.when(token.rlike("^-?[0-9]"), "n").when(token.isin(">=", "≥"), "g").when(token.rlike(r"^\s"), "_")
    for letter, words in FLOOR_WORDS.items():
        kind = kind.when(token.isin(words), letter)
    return kind.when(token.rlike(r"^\p{L}"), "w").otherwise(token)


def _at(kinds: Column, tokens: Column, sequence: str, valued: str) -> Column:
    """The tokens of the kinds ``valued`` where ``sequence`` first occurs; null if it does not."""
    def values(found: Column) -> Column:
        here = F.slice(tokens, F.regexp_instr(kinds, F.lit(f"({sequence})")), F.length(found))
        own = F.filter(F.arrays_zip(here.alias("token"), F.split(found, "").alias("kind")), lambda x: x["kind"].rlike(f"^[{valued}]$"))
        return F.when(found != "", F.transform(own, lambda x: x["token"]))

    return _with(F.regexp_extract(kinds, f"({sequence})", 1), values)


def _first(text: Column, number: str, kind, forms: list, valued: str, of_values) -> Column:
    """What ``of_values`` makes of the first form that occurs in the text."""
    def look(tokens: Column) -> Column:
        return _with(_kinds(tokens, kind), lambda kinds: F.coalesce(*[_with(_at(kinds, tokens, sequence, valued), _made(of_values, told)) for sequence, told in forms]))

    return _with(_cut(text, number), look)


def _made(of_values, told):
    return lambda values: F.when(values.isNotNull(), of_values(values, told))


def named_day(text: Column, today: str) -> Column:
    """The day a question names as yyyy-mm-dd; without a year the latest not after ``today``; null for none or an impossible one."""
    number = F.create_map(*[F.lit(v) for form, i in MONTHS.items() if len(form) == 3 for v in (form, i)])

    def dated(values: Column, order: str) -> Column:
        year, month, day = (F.get(values, F.lit(order.index(part))) for part in "ymd")
        named = F.coalesce(F.element_at(number, F.substring(month, 1, 3)), month.try_cast("int"))
        tail = F.concat(F.lit("-"), F.lpad(named.cast("string"), 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))
        year_of = lambda t: F.coalesce(year, F.when(F.concat(F.lit(today[:4]), t) > today, str(int(today[:4]) - 1)).otherwise(today[:4]))
        return _with(tail, lambda t: F.concat(year_of(t), t))

    return _with(_first(text, "[0-9]+", _date_kind, DATES, "YNMp", dated), lambda d: F.when(d.try_cast("date").isNotNull(), d))


def magnitude_floor(text: Column) -> Column:
    """A struct (value, inclusive) of the least magnitude a question asks for; null where it asks for none."""
    def floor(values: Column, inclusive: bool) -> Column:
        return F.struct(F.get(values, F.lit(0)).try_cast("double").alias("value"), F.lit(inclusive).alias("inclusive"))

    return _first(text, r"-?[0-9]+(?:\.[0-9]+)?", _floor_kind, FLOORS, "n", floor)


def located_until(page: Column) -> Column:
    """How far a catalogue's page says that its locations reach, as a time in UTC; null where it does not say."""
    said = F.regexp_extract(F.lower(page), r"locations up to\s+([0-9]{1,2}-[a-z]{3}-[0-9]{4}\s+[0-9:]{8})\s*utc", 1)
    return F.try_to_timestamp(F.initcap(F.regexp_replace(said, r"\s+", " ")), F.lit("d-MMM-yyyy HH:mm:ss"))
