"""Chunkers whose cuts depend on the cut before, as column expressions and one packing step per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The signs that end a sentence for the chunker.
SENTENCE_ENDS = (".", "!", "?", ":", ";", ")")


def sentence_chunks(words: Column, whole: int = 650, size: int = 450, overlap: int = 60, least: int = 250, back: int = 80) -> Column:
    """Texts of the chunks of an array of words.

    Up to ``whole`` words stay whole. Beyond that the cut points come first: a chunk
    spans ``size`` words, or ends after the last sentence end among its last ``back``
    words (never within its first ``least``), and the next one begins ``overlap``
    words before. Each step looks at ``back`` words only, so the cost is linear.
    """
    n = F.size(words)

    def span(start: Column) -> Column:
        stop = start + size
        tail = F.sequence(F.greatest(start + least, stop - back) + 1, stop)
        ends = F.filter(tail, lambda i: F.right(F.get(words, i - 1), F.lit(1)).isin(*SENTENCE_ENDS))
        return F.struct(start.alias("a"), F.when(stop >= n, n).otherwise(F.coalesce(F.array_max(ends), stop)).alias("b"))

    def grow(spans: Column, _: Column) -> Column:
        last = F.element_at(spans, -1)
        following = F.greatest(last["a"] + 1, last["b"] - overlap)
        return F.when(last["b"] >= n, spans).otherwise(F.concat(spans, F.array(span(following))))

    advance = max(1, max(least, size - back) + 1 - overlap)
    steps = F.sequence(F.lit(1), F.floor(n / advance).cast("int") + 1)
    spans = F.aggregate(steps, F.array(span(F.lit(0))), grow)
    cut = F.transform(spans, lambda s: F.array_join(F.slice(words, s["a"] + 1, s["b"] - s["a"]), " "))
    return F.when(n <= 0, F.array().cast("array<string>")).when(n <= whole, F.array(F.array_join(words, " "))).otherwise(cut)


def heading_chunks(docs: DataFrame, id_: str, text: str, title: str, most: int = 600, size: int = 520, overlap: int = 50) -> DataFrame:
    """(id, chunk, headings, words, body): sections under '#' blocks, cut into units and packed across headings.

    Blocks stand between blank lines; one that starts with '#' names the section after
    it, ``title`` the one before the first. A section's words are cut into units of
    ``size`` that share ``overlap``; a unit carries its heading as a line. Units are packed
    in order while a chunk stays within ``most`` words, headings counted. ``id_`` is unique.
    """
    blocks = docs.select(id_, F.col(title).alias("_title"), F.posexplode(F.split(F.col(text), "\n\n")).alias("_pos", "_block"))
    head = F.col("_block").startswith("#")
    so_far = Window.partitionBy(id_).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("_section", F.sum(head.cast("int")).over(so_far))
    blocks = blocks.withColumn("_heading", F.coalesce(F.last(F.when(head, F.trim(F.regexp_replace("_block", "^[# ]+", ""))), True).over(so_far), "_title"))
    words = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_words"))), lambda b: b["_words"]))
    sections = blocks.where(~head).withColumn("_words", _words("_block")).groupBy(id_, "_section", "_heading").agg(words.alias("_words")).where(F.size("_words") > 0)
    # The last unit is the first to reach the section's end.
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("_words") - size) / F.lit(float(size - overlap))).cast("int")) * (size - overlap), F.lit(size - overlap))
    units = sections.select(id_, "_section", "_heading", "_words", F.explode(starts).alias("_start"))
    units = units.select(id_, "_section", "_start", "_heading", F.slice("_words", F.col("_start") + 1, F.lit(size)).alias("_words"))
    body = F.concat(F.lit("## "), F.col("_heading"), F.lit("\n\n"), F.array_join("_words", " "))
    units = units.select(id_, F.struct("_section", "_start", "_heading", (1 + F.size(_words("_heading")) + F.size("_words")).alias("_n"), body.alias("_body")).alias("_unit"))
    packed = units.groupBy(id_).agg(F.array_sort(F.collect_list("_unit")).alias("_units")).withColumn("_parts", _pack("_units", most))
    rows = packed.select(id_, F.explode(F.arrays_zip("_units", "_parts")).alias("_x")).select(id_, F.col("_x._parts").alias("chunk"), "_x._units.*")
    ordered = F.array_sort(F.collect_list(F.struct("_section", "_start", "_heading", "_body", "_n")))
    return (
        rows.groupBy(id_, "chunk")
        .agg(ordered.alias("_u"))
        .select(
            id_,
            "chunk",
            F.array_distinct(F.transform("_u", lambda u: u["_heading"])).alias("headings"),
            F.aggregate("_u", F.lit(0), lambda s, u: s + u["_n"]).cast("long").alias("words"),
            F.array_join(F.transform("_u", lambda u: u["_body"]), "\n\n").alias("body"),
        )
    )


def _words(column: str) -> Column:
    return F.regexp_extract_all(F.col(column), F.lit(r"([^ \t\n\r]+)"), 1)


def _pack(units: str, most: int) -> Column:
    """The chunk number of each unit: a new one begins where the words of the open one would pass ``most``."""

    def step(state: Column, unit: Column) -> Column:
        fresh = (state["held"] > 0) & (state["held"] + unit["_n"] > most)
        part = F.when(fresh, state["part"] + 1).otherwise(state["part"])
        held = F.when(fresh, unit["_n"]).otherwise(state["held"] + unit["_n"])
        return F.struct(part.alias("part"), held.alias("held"), F.concat(state["parts"], F.array(part)).alias("parts"))

    first = F.struct(F.lit(0).alias("part"), F.lit(0).alias("held"), F.array().cast("array<int>").alias("parts"))
    return F.aggregate(F.col(units), first, step, lambda s: s["parts"])
