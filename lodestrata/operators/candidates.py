"""Candidate links between papers and sensors or features, collected from passages.

Thousands of codes cost no more than one: what has the shape of a code is taken from each
passage once and joined with the codes by equality. Names of several words are found by
their first word, joined with the passages' words, and the rest is compared at that place.
Nearness is measured in characters between the places of two names in one passage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import spread
from ..sources.shared import materialize
from ..sources.shipping import ship

#: Characters between a site's name and an instrument's, and how far a range of codes may reach.
NEAR = 300
RANGE_LENGTH = 5
#: Which kind of hit a link keeps of a passage that makes it in several ways.
KINDS = ("named", "range", "designator", "system", "described", "feature")
DASH = "[-‐‑‒–—]"
#: Names up to this many travel to every task; their words are a few megabytes.
BROADCAST_ROWS = 100_000
DESIGNATOR = r"(?<![A-Za-z0-9_])((?:RS|CE)[0-9]{2}[A-Z0-9]{4}-?[A-Z0-9]{5}-(?:[0-9]{2}-)?[A-Z0-9]{9})(?![A-Za-z0-9_])"


def name_hits(passages: DataFrame, names: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, name, start, end of every place where a name stands in a passage, as whole words with any gaps between.

    ``passages`` has ``keep`` (a key of the passage) and text; ``names`` has name and phrase. Letters count as they are.
    """
    wanted = names.select("name", F.regexp_extract_all("phrase", F.lit("([A-Za-z0-9]+)"), 1).alias("words")).where(F.size("words") > 0).distinct()
    wanted = materialize(wanted.withColumn("word", F.get("words", F.lit(0))), "wanted")
    rows, longest = wanted.agg(F.count(F.lit(1)), F.max(F.size("words"))).first()
    # Only words that open a name leave the text, with as many after them as the longest name has; of very many names every word does.
    opening = {r.word for r in wanted.select("word").distinct().collect()} if rows <= BROADCAST_ROWS else None
    ship(passages.sparkSession)
    longest = longest or 0
    word = re.compile("[A-Za-z0-9]+")

    def openings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, first, start, said, ends = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = [(m.group(), m.start(), m.end()) for m in word.finditer(text or "")]
                for k, (w, at, _) in enumerate(found):
                    if opening is None or w in opening:
                        own = found[k : k + longest]
                        row.append(i)
                        first.append(w)
                        start.append(at)
                        said.append([o[0] for o in own])
                        ends.append([o[2] for o in own])
            columns = [*(batch.column(c).take(pa.array(row, pa.int64())) for c in keep), pa.array(first, pa.string()), pa.array(start, pa.int32()), pa.array(said, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "word", "start", "said", "ends"])

    schema = StructType([*(passages.schema[c] for c in keep), *StructType.fromDDL("word string, start int, said array<string>, ends array<int>")])
    words = passages.select(*keep, "text").mapInArrow(openings, schema)
    found = words.join(F.broadcast(wanted) if opening is not None else wanted, "word")
    n = F.size("words")
    return found.where(F.slice("said", F.lit(1), n) == F.col("words")).select(*keep, "name", "start", F.get("ends", n - 1).alias("end"))


def code_hits(passages: DataFrame, keep: list[str], shape: str, prefixes: list[str]) -> DataFrame:
    """``keep``, code, kind, start of codes by themselves ('named') and within ranges such as AB11-14 or AB11 to AB14 ('range').

    ``shape`` is a regular expression of a code; ranges are read for codes of ``prefixes`` and a number.
    """
    edge, end = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
    named = F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(f"{edge}({shape}){end}"), 1)), lambda c: F.struct(c.alias("code"), F.lit("named").alias("kind"), c.alias("said")))
    one = "|".join(prefixes)
    ranges = F.regexp_extract_all("text", F.lit(rf"{edge}((?:{one})[0-9]{{1,2}}\s*(?:{DASH}|to)\s*(?:{one})?[0-9]{{1,2}}){end}"), 1)
    rows = passages.select(*keep, "text", F.explode(F.concat(named, F.flatten(F.transform(ranges, _expand)))).alias("hit"))
    return rows.select(*keep, "hit.code", "hit.kind", _place(F.col("hit.said")).alias("start"))


def _place(said: Column) -> Column:
    """Where what was found first stands by itself in the text."""
    return F.regexp_instr("text", F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), said, F.lit(r"\E(?![A-Za-z0-9_])"))) - 1


def _expand(said: Column) -> Column:
    prefix, second = F.regexp_extract(said, "^([A-Z]+)", 1), F.regexp_extract(said, "([A-Z]*)[0-9]+$", 1)
    numbers = F.regexp_extract_all(said, F.lit("([0-9]+)"), 1)
    low, high = (F.get(numbers, F.lit(i)).cast("int") for i in (0, 1))
    right = ((second == "") | (second == prefix)) & (low < high) & (high <= low + RANGE_LENGTH)
    every = F.when(right, F.sequence(low, F.least(high, low + RANGE_LENGTH)))
    return F.coalesce(F.transform(every, lambda n: F.struct(F.concat(prefix, n.cast("string")).alias("code"), F.lit("range").alias("kind"), said.alias("said"))), F.array().cast("array<struct<code:string,kind:string,said:string>>"))


def designator_keys(designator: Column) -> Column:
    """A designator as it stands, without its port, and without node and port."""
    parts = F.regexp_extract(designator, "^(.{8})-?(.{5})-(?:[0-9]{2}-)?(.{9})$", 1), F.regexp_extract(designator, "^(.{8})-?(.{5})-", 2), F.right(designator, F.lit(9))
    return F.array_distinct(F.array(designator, F.concat_ws("-", *parts), F.concat_ws("-", parts[0], parts[2])))


def candidate_links(passages: DataFrame, papers: DataFrame, codes: DataFrame, designators: DataFrame, names: DataFrame, sensors: DataFrame, systems: DataFrame, shape: str, prefixes: list[str], first_year: int = 2009) -> DataFrame:
    """(paper, target, passage, kind, layer, start, share, stations): one hit for each passage that may link a paper and a target.

    ``passages``: paper, layer, passage (an id), text. ``papers``: paper, year. ``codes``: code, sensor. ``designators``:
    designator, sensor. ``names``: group ('signal', 'context', 'site', 'kind', 'system' or 'feature'), name, phrase, needs (a
    context's name, or null). ``sensors``: sensor, site, kind. ``systems``: system, sensor, signalled (only in papers
    with a signal). Papers without a row take no part.

    A signal is a phrase by which a paper says that it is about the network, or any code. A site's name and an instrument's kind within
    ``NEAR`` characters describe the sensors of that kind there, in a paper with a signal from ``first_year`` on. A system's name
    means its one sensor, else those whose site is named within twice ``NEAR``, else, in a paper with a signal, all of
    them as described. ``share`` is how many sensors the words fit, if more than one.
    """
    keep = ["paper", "passage"]
    rows = materialize(passages.join(papers.select("paper", "year"), "paper"), "passages")
    coded = materialize(code_hits(rows, keep, shape, prefixes), "codes")
    said = materialize(name_hits(rows, names.select(F.struct("group", "name").alias("name"), "phrase"), keep).select(*keep, "name.group", "name.name", "start", "end"), "names")
    stations = coded.where("kind = 'named'").groupBy(*keep).agg(F.count_distinct("code").alias("stations"))
    signalled = said.where("group = 'signal'").select("paper").union(coded.where("kind = 'named'").select("paper")).distinct()
    context = said.where("group = 'context'").select(*keep, F.col("name").alias("needs")).distinct()
    needs = names.where("needs IS NOT NULL").select("group", "name", "needs").distinct()
    held = said.join(F.broadcast(needs), ["group", "name"], "left")  # the names' own table
    allowed = held.where("needs IS NULL").drop("needs").unionByName(held.where("needs IS NOT NULL").join(context, [*keep, "needs"], "left_semi").drop("needs"))
    allowed = materialize(allowed, "allowed")
    none = F.lit(None).cast("long").alias("share")
    out = [coded.join(codes, "code").select(*keep, F.col("sensor").alias("target"), "kind", "start", none)]

    text_keys = spread(rows, [*keep, "text"], F.regexp_extract_all("text", F.lit(DESIGNATOR), 1), "said").select(*keep, F.explode(designator_keys(F.col("said"))).alias("key"), _place(F.col("said")).alias("start"))
    own_keys = designators.select("sensor", F.explode(designator_keys(F.col("designator"))).alias("key")).distinct()
    out.append(text_keys.join(own_keys, "key").select(*keep, F.col("sensor").alias("target"), F.lit("designator").alias("kind"), "start", none))

    sites = allowed.where("group = 'site'").select(*keep, F.col("name").alias("site"), "start", "end")
    kinds = said.where("group = 'kind'").select(*keep, F.col("name").alias("kind"), F.col("start").alias("kind_start"), F.col("end").alias("kind_end"))
    dated = sites.join(papers.where(F.col("year") >= first_year).select("paper"), "paper", "left_semi").join(signalled, "paper", "left_semi")
    beside = dated.join(kinds, keep).where((F.col("kind_start") >= F.col("start") - NEAR) & (F.col("kind_end") <= F.col("end") + NEAR))
    there = sensors.where("site IS NOT NULL AND kind IS NOT NULL").select("sensor", "site", "kind").distinct()
    sizes = there.groupBy("site", "kind").agg(F.count(F.lit(1)).alias("share"))
    described = beside.groupBy(*keep, "site", "kind").agg(F.min("start").alias("start")).join(sizes, ["site", "kind"]).join(there, ["site", "kind"])
    out.append(described.select(*keep, F.col("sensor").alias("target"), F.lit("described").alias("kind"), "start", "share"))

    first = allowed.where("group = 'system'").groupBy(*keep, "name").agg(F.min_by(F.struct("start", "end"), "start").alias("at"))
    members = systems.groupBy("system").agg(F.count(F.lit(1)).alias("members"), F.max("signalled").alias("signalled"))
    first = first.withColumnRenamed("name", "system").join(members, "system").join(signalled.withColumn("signal", F.lit(True)), "paper", "left")
    first = first.where(~F.col("signalled") | F.col("signal")).join(systems.select("system", "sensor"), "system").join(sensors.select("sensor", "site"), "sensor", "left")
    places = said.where("group = 'site'").select(*keep, F.col("name").alias("site"), F.col("start").alias("s"), F.col("end").alias("e"))
    near = (F.col("s") >= F.col("at.start") - 2 * NEAR) & (F.col("e") <= F.col("at.end") + 2 * NEAR)
    with_site = first.join(places, [*keep, "site"], "left").groupBy(*keep, "system", "sensor").agg(F.first("at.start").alias("start"), F.first("members").alias("members"), F.first("signal").alias("signal"), F.coalesce(F.bool_or(near), F.lit(False)).alias("near"))
    nearby = with_site.groupBy(*keep, "system").agg(F.count_if("near").alias("nearby"))
    judged = with_site.join(nearby, [*keep, "system"])
    alone, some = F.col("members") == 1, F.col("nearby") > 0
    kind = F.when(alone | (some & F.col("near")), "system").when(~some & F.col("signal"), "described")
    share = F.when(alone, None).when(some, F.when(F.col("nearby") > 1, F.col("nearby"))).otherwise(F.col("members"))
    out.append(judged.select(*keep, F.col("sensor").alias("target"), kind.alias("kind"), "start", share.alias("share")).where("kind IS NOT NULL"))

    features = allowed.where("group = 'feature'").groupBy(*keep, F.col("name").alias("target")).agg(F.min("start").alias("start"))
    out.append(features.select(*keep, "target", F.lit("feature").alias("kind"), "start", none))

    every = out[0].select(*keep, "target", "kind", F.col("start").cast("long").alias("start"), "share")
    for part in out[1:]:
        every = every.unionByName(part.select(*keep, "target", "kind", F.col("start").cast("long").alias("start"), "share"))
    order = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(KINDS)])
    best = every.groupBy(*keep, "target").agg(F.min_by(F.struct("kind", "start", "share"), F.struct(order, "start", F.coalesce("share", F.lit(0)))).alias("hit"))
    layer = rows.select(*keep, "layer")
    out_rows = best.join(layer, keep).join(stations, keep, "left")
    return out_rows.select("paper", "target", "passage", "hit.kind", "layer", "hit.start", "hit.share", F.coalesce("stations", F.lit(0)).alias("stations"))
