"""Whether an answer states a fact: a date in any of its usual forms, a number within a tolerance, a word by itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def states_date(text: Column, day: Column) -> Column:
    """``day`` is yyyy-mm-dd: written so, with slashes, or by its month's name (at least three letters) before or after the number."""
    date = day.cast("date")
    number, year, month = F.dayofmonth(date).cast("string"), F.year(date).cast("string"), F.date_format(date, "MMM")
    forms = F.concat(
        F.lit("(?i)"), F.substring(day, 1, 10), F.lit("|"), month, F.lit(r"\w*\.?\s+"), number, F.lit(r",?\s+"), year,
        F.lit(r"|\b"), number, F.lit(r"\s+"), month, F.lit(r"\w*\.?,?\s+"), year, F.lit("|"), F.date_format(date, "yyyy/MM/dd"),
    )
    return F.regexp_like(text, forms)


def states_number(text: Column, value: Column, tolerance: Column) -> Column:
    """A number of the text, with commas between its digits or not, lies within ``tolerance`` of ``value``; the digits of a code such as AB-12 are none."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z_]+-?[0-9][\w-]*|([0-9][0-9,]*\.?[0-9]*)"), 1), lambda n: F.replace(n, F.lit(","), F.lit("")).try_cast("double"))
    return F.exists(numbers, lambda n: F.coalesce(F.abs(n - value) <= tolerance, F.lit(False)))


def states_word(text: Column, word: Column) -> Column:
    return F.regexp_like(text, F.concat(F.lit(r"(?i)(?<![\w-])\Q"), word, F.lit(r"\E(?![\w-])")))
