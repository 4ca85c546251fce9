"""Papers that name a code, by itself or within a range such as AB11-14."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import spread
from ..sources.shared import materialize

#: A code's form, and how many codes and results a question may have.
CODE = re.compile(r"[A-Za-z0-9-]{3,40}")
MOST_CODES, MOST_RESULTS = 6, 20
RANGE_LENGTH = 50


def papers_naming(passages: DataFrame, codes: list[str], id_: str, paper: str, body: str, limit: int = 10) -> DataFrame:
    """paper, passages, best, named: papers with a passage that names a code, most codes first.

    A code counts where no letter or digit touches it. A code of capitals and a number is also named by a
    range with its capitals whose numbers take it in, the second below ``RANGE_LENGTH`` more than the first.
    The best passage names most; a range counts once. Passages are read once and one row each is kept.
    """
    wanted = sorted({c for c in codes[:MOST_CODES] if CODE.fullmatch(c)})
    parts = {c: m for c in wanted if (m := re.fullmatch(r"([A-Z]+)([0-9]+)", c))}
    prefixes = sorted({m[1] for m in parts.values()})
    spans = passages.select(F.col(paper).alias("paper"), F.col(id_).alias("id"), F.col(body).alias("body"), *[_spans(F.col(body), p).alias(f"span_{p}") for p in prefixes])
    hits = []
    for code in wanted:
        literal = F.contains("body", F.lit(code)) & F.col("body").rlike(f"(^|[^A-Za-z0-9]){code}($|[^A-Za-z0-9])")
        times = ((F.length("body") - F.length(F.replace(F.col("body"), F.lit(code), F.lit("")))) / len(code)).cast("long")
        hits.append(F.when(literal, F.struct(F.lit(code).alias("code"), times.alias("n"))))
        if code in parts:
            within = F.size(F.filter(f"span_{parts[code][1]}", _takes_in(int(parts[code][2])))).cast("long")
            hits.append(F.when(within > 0, F.struct(F.lit(code).alias("code"), within.alias("n"))))
    if not hits:
        return passages.where("false").select(F.col(paper).alias("paper"), F.lit(0).cast("long").alias("passages"), F.col(id_).alias("best"), F.array().cast("array<string>").alias("named"))
    found = spans.select("paper", "id", F.array_compact(F.array(*hits)).alias("hits"))
    # A filter on the hits would be pushed below them and make them again, expression by expression.
    both = F.struct(F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("n"), F.array_distinct(F.transform("hits", lambda x: x["code"])).alias("codes"))
    found = spread(found, ["paper", "id"], F.when(F.size("hits") > 0, F.array(both)), "hit").select("paper", "id", "hit.n", "hit.codes")
    found = materialize(found, "naming")  # read twice below
    papers = found.groupBy("paper").agg(F.count_distinct("id").alias("passages"), F.min_by("id", F.struct(-F.col("n"), "id")).alias("best"))
    named = spread(found, ["paper"], F.col("codes"), "code").groupBy("paper").agg(F.array_sort(F.collect_set("code")).alias("named"))  # at most MOST_CODES
    out = papers.join(named, "paper")
    return out.orderBy(F.desc(F.size("named")), F.desc("passages"), "paper").limit(max(1, min(limit, MOST_RESULTS)))


def _spans(body, prefix: str):
    """The ranges of codes with ``prefix``: low and high number of each. A range's end is looked at, not taken, so that it may begin the next one."""
    found = F.regexp_extract_all(body, F.lit(rf"(?:^|[^A-Za-z0-9])({prefix}[0-9]{{1,9}}\s?[-‐‑–—]\s?(?:{prefix})?[0-9]{{1,9}})(?=$|[^A-Za-z0-9])"), 1)
    numbers = F.transform(found, lambda x: F.transform(F.regexp_extract_all(x, F.lit("([0-9]+)"), 1), lambda n: n.cast("long")))
    spans = F.transform(numbers, lambda n: F.struct(F.get(n, F.lit(0)).alias("low"), F.get(n, F.lit(1)).alias("high")))
    return F.when(F.contains(body, F.lit(prefix)), F.filter(spans, lambda s: (s["low"] < s["high"]) & (s["high"] - s["low"] < RANGE_LENGTH)))


def _takes_in(number: int):
    return lambda s: (s["low"] <= number) & (s["high"] >= number)
