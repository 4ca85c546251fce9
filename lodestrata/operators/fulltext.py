"""Full-text search with one's own words: a positional index by stems, boolean queries, cover-density ranks.

An index is a table of postings (stem, document, places) in directories by a hash of the
stem, each file sorted by stem, so that a query reads the postings of its own words only, and
a table of the documents with their lengths. It is a snapshot: build it anew when the
documents change. Common words are spread over as many files as their postings need.

A query is words that must all occur, "or" between alternatives, quotes for a phrase and a
minus for what must not occur; "or" binds weaker than the rest. Its first ``QUERY_LENGTH`` signs
count. Stop words are left out and keep their place within a phrase.

Ranks are cover densities: a cover is a shortest run of a document's hits that satisfies the
query, found by one sweep over the hits in order of position. A cover of hits with weights w
scores their number over the sum of 1 / w, divided by one more than the words between
them that are no hits; a document has the sum over its covers.

A document counts for an alternative only if it has none of its excluded words at all; an
alternative of excluded words alone matches with rank 0. Positions are not clipped.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stemming
from ..functions.text import spread
from ..sources.shared import fresh_path, materialize

QUERY_LENGTH = 1000
BUCKETS = 16
PART_ROWS = 2_000_000
#: Words with their stems up to this many are sent to every task.
VOCABULARY = 200_000
#: What a hit weighs by the field it stands in.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
WORD = r"[\p{L}\p{N}]+"


class Index(NamedTuple):
    """Where an index lies; ``postings`` and ``documents`` read it."""

    spark: SparkSession
    path: str
    id: str

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    @property
    def documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/documents")

    def of(self, stems: list[str]) -> DataFrame:
        """The postings of ``stems``: only their directories are read, and in these the blocks that may hold them."""
        buckets = self.spark.createDataFrame([(s,) for s in stems], "stem string").select(_bucket(F.col("stem"))).distinct()
        wanted = [r[0] for r in buckets.collect()] if stems else []
        return self.postings.where(F.col("bucket").isin(wanted) & F.col("stem").isin(stems))


def _bucket(stem: Column) -> Column:
    return F.pmod(F.xxhash64(stem), F.lit(BUCKETS)).cast("int").alias("bucket")


def placed_words(docs: DataFrame, id_: str, fields: list[tuple[Column, str]]) -> DataFrame:
    """id and found: the words of all fields in order, with position and weight; a field goes on where the one before ended."""
    cut = [F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), 1).alias(f"_w{i}") for i, (text, _) in enumerate(fields)]
    # Words and their numbers are columns of their own: within a lambda they would be made again for every word.
    held = docs.select(F.col(id_), *cut)
    held = held.select("*", *[F.size(f"_w{i}").alias(f"_n{i}") for i in range(len(fields))])
    parts, before = [], F.lit(0)
    for i, (_, weight) in enumerate(fields):
        parts.append(F.transform(f"_w{i}", _placed(before, WEIGHTS[weight])))
        before = before + F.col(f"_n{i}")
    return held.select(id_, F.concat(*parts).alias("found"), before.alias("length"))


def _placed(before: Column, weight: float):
    return lambda w, i: F.struct(w.alias("word"), (before + i + 1).cast("int").alias("pos"), F.lit(weight).alias("weight"))


def build(docs: DataFrame, id_: str, fields: list[tuple[Column, str]], label: str = "fulltext") -> Index:
    """Index the ``fields`` of ``docs``, each with the letter of its weight."""
    spark = docs.sparkSession
    index = Index(spark, fresh_path(spark, label), id_)
    found = placed_words(docs, id_, fields)
    found.select(id_, "length").write.parquet(f"{index.path}/documents")
    size = spark.read.parquet(f"{index.path}/documents").agg(F.sum("length")).first()[0] or 0
    words = spread(found.select("found"), [], F.transform("found", lambda w: w["word"]), "word").distinct()
    stems = materialize(stemming.stem(words.where(~F.col("word").isin(stemming.STOP_WORDS))), "stems")  # each different word is stemmed once
    stems = F.broadcast(stems) if stems.count() <= VOCABULARY else stems
    # Texts are dealt by document once, so words are grouped where they are cut; a place is one number until it is written.
    here = placed_words(docs.repartition(id_), id_, fields)
    rows = spread(here.select(id_, "found"), [id_], F.col("found"), "hit").where(~F.col("hit.word").isin(stemming.STOP_WORDS))
    kinds = F.array(*[F.lit(w) for w in WEIGHTS.values()])
    place = (F.col("hit.pos") * len(WEIGHTS) + F.array_position(kinds, F.col("hit.weight")) - 1).cast("int")
    grouped = rows.groupBy(id_, F.col("hit.word").alias("word")).agg(F.collect_list(place).alias("places"))
    parts = max(1, -(-size // (PART_ROWS * BUCKETS)))
    dealt = grouped.join(stems, "word").select("stem", id_, "places", _bucket(F.col("stem")), F.pmod(F.xxhash64(id_), F.lit(parts)).alias("part"))
    dealt.repartition(BUCKETS * parts, "bucket", "part").drop("part").sortWithinPartitions("bucket", "stem", id_).withColumn("places", F.transform("places", _unpacked)).write.partitionBy("bucket").parquet(f"{index.path}/postings")
    return index


def _unpacked(place: Column) -> Column:
    kinds = F.array(*[F.lit(w) for w in WEIGHTS.values()])
    return F.struct(F.floor(place / len(WEIGHTS)).cast("int").alias("pos"), F.get(kinds, F.pmod(place, F.lit(len(WEIGHTS)))).alias("weight"))


class Item(NamedTuple):
    """Words that stand at fixed distances from the first, wanted or excluded."""

    words: tuple[str, ...]
    offsets: tuple[int, ...]
    excluded: bool


def alternatives(question: str | None) -> list[list[Item]]:
    """The query's alternatives, each a list of items; empty ones are left out."""
    out: list[list[Item]] = [[]]
    for minus, phrase, bare in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', (question or "")[:QUERY_LENGTH]):
        if bare.lower() == "or" and not minus:
            out.append([])
            continue
        words = [w.lower() for w in re.findall(r"[^\W_]+", phrase or bare)]
        kept = [(w, i) for i, w in enumerate(words) if w not in stemming.STOP_WORDS]
        if kept:
            out[-1].append(Item(tuple(w for w, _ in kept), tuple(i - kept[0][1] for _, i in kept), bool(minus)))
    return [group for group in out if group]


def stemmed(spark: SparkSession, groups: list[list[Item]]) -> list[list[Item]]:
    """The items with stems for words: at most ``QUERY_LENGTH`` signs of words are stemmed."""
    words = sorted({w for group in groups for item in group for w in item.words})
    if not words:
        return groups
    table = dict(tuple(r) for r in stemming.stem(spark.createDataFrame([(w,) for w in words], "word string")).collect())
    return [[item._replace(words=tuple(table[w] for w in item.words)) for item in group] for group in groups]


def search(index: Index, question: str | None) -> DataFrame:
    """(id, rank) of the documents that satisfy the question, ``rank`` being the cover density."""
    groups = stemmed(index.spark, alternatives(question))
    id_ = index.id
    wanted = sorted({w for group in groups for item in group if not item.excluded for w in item.words})
    excluded = [item for group in groups for item in group if item.excluded]
    stems = sorted({w for item in excluded for w in item.words} | set(wanted))
    if not groups:
        return index.documents.where("false").select(id_, F.lit(0.0).alias("rank"))
    hits = spread(index.of(stems), [id_, "stem"], F.col("places"), "place").select(id_, "stem", "place.pos", F.when(F.col("stem").isin(wanted), 1.0 / F.col("place.weight")).alias("cost"))
    items = list(dict.fromkeys(item for group in groups for item in group))
    order = Window.partitionBy(id_).orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("n", F.count("cost").over(upto)).withColumn("costs", F.sum("cost").over(upto))
    at = F.struct(F.col("pos").alias("pos"), F.col("n").alias("n"), (F.col("costs") - F.col("cost")).alias("costs"), "stem")
    longest = max(item.offsets[-1] for item in items)
    if longest:
        hits = hits.withColumn("near", F.collect_list(at).over(order.rowsBetween(-longest, 0)))
    # ``near`` holds the hits at most as far back as a phrase is long.
    hits = hits.select("*", *[_start(item, at).alias(f"start{i}") for i, item in enumerate(items)])
    last = [F.last(f"start{i}", True).over(upto).alias(f"last{i}") for i in range(len(items))]
    found = [F.max(F.col(f"start{i}").isNotNull()).over(Window.partitionBy(id_)).alias(f"has{i}") for i in range(len(items))]
    hits = hits.select(id_, "pos", "n", "costs", *last, *found)
    number = {item: i for i, item in enumerate(items)}
    covers, fits = [], []
    for group in groups:
        inside = [number[i] for i in group if not i.excluded]
        outside = [number[i] for i in group if i.excluded]
        clean = reduce(lambda a, b: a & b, [~F.col(f"has{i}") for i in outside], F.lit(True))
        fits.append(reduce(lambda a, b: a & b, [F.col(f"has{i}") for i in inside], clean))
        if inside:
            starts = [F.col(f"last{i}") for i in inside]
            whole = reduce(lambda a, b: a & b, [s.isNotNull() for s in starts], clean)
            covers.append(F.when(whole, F.least(*starts) if len(starts) > 1 else starts[0]))
    begin = (F.greatest(*covers) if len(covers) > 1 else covers[0]) if covers else F.lit(None).cast("struct<pos:int,n:bigint,costs:double,stem:string>")
    hits = hits.select(id_, "pos", "n", "costs", begin.alias("begin"), reduce(lambda a, b: a | b, fits).alias("fits"))
    new = F.col("begin.n") > F.coalesce(F.max("begin.n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hits = hits.select(id_, "fits", F.when(new, _density()).alias("cover"))
    out = hits.groupBy(id_).agg(F.bool_or("fits").alias("fits"), F.coalesce(F.sum("cover"), F.lit(0.0)).alias("rank"))
    if all(any(not item.excluded for item in group) for group in groups):
        return out.where("fits").select(id_, "rank")
    without_any = index.documents.select(id_).join(out, id_, "left")  # an alternative of excluded words alone holds where nothing was hit
    return without_any.where(F.coalesce("fits", F.lit(True))).select(id_, F.coalesce("rank", F.lit(0.0)).alias("rank"))


def _start(item: Item, at: Column) -> Column:
    """At a hit that ends the item: where the item starts."""
    here = F.col("stem") == item.words[-1]
    if len(item.words) == 1:
        return F.when(here, at)
    first = F.col("pos") - item.offsets[-1]
    stands = [F.exists("near", _stands(w, first + o)) for w, o in zip(item.words[:-1], item.offsets[:-1], strict=True)]
    start = F.filter("near", lambda x: (x["stem"] == item.words[0]) & (x["pos"] == first))
    return F.when(reduce(lambda a, b: a & b, stands, here), F.get(start, F.lit(0)))


def _stands(stem: str, pos: Column):
    return lambda x: (x["stem"] == stem) & (x["pos"] == pos)


def _density() -> Column:
    """The score of the cover from ``begin`` to this hit."""
    hits = F.col("n") - F.col("begin.n") + 1
    between = F.col("pos") - F.col("begin.pos") + 1 - hits
    return hits / (F.col("costs") - F.col("begin.costs")) / (1 + F.greatest(between, F.lit(0)))


def bm25(index: Index, words: list[str], heading: str = "B", bonus: float = 0.75, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) by Okapi weights over the index; a repeated word counts again, one in the heading adds ``bonus`` once."""
    id_ = index.id
    times = {}
    for w in words:
        times[w] = times.get(w, 0) + 1
    if not times:
        return index.documents.where("false").select(id_, F.lit(0.0).alias("score"))
    asked = stemming.stem(index.spark.createDataFrame(list(times.items()), "word string, times int"))
    asked = {r["stem"]: r["times"] for r in asked.groupBy("stem").agg(F.sum("times").alias("times")).collect()}
    tf = index.of(sorted(asked)).groupBy(id_, "stem").agg(
        F.sum(F.size("places")).alias("tf"), F.max(F.exists("places", lambda p: p["weight"] == WEIGHTS[heading])).alias("headed")
    )
    df = tf.groupBy("stem").agg(F.count(F.lit(1)).alias("df"))  # a row a word of the question
    stats = index.documents.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
    weight = reduce(lambda c, kv: c.when(F.col("stem") == kv[0], kv[1]), asked.items(), F.when(F.lit(False), 0))
    part = weight * F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1)
    part = part / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    scored = tf.join(F.broadcast(df), "stem").join(index.documents, id_).crossJoin(F.broadcast(stats))
    return scored.groupBy(id_).agg((F.sum(part) + F.when(F.max("headed"), bonus).otherwise(0.0)).alias("score")).where("score > 0")


def best(found: DataFrame, id_: str, score: str, k: int) -> DataFrame:
    """The k best by score with their place in ``rank``, ties to the smaller id."""
    top = found.select(id_, F.col(score).alias("score")).orderBy(F.desc("score"), id_).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_)).cast("long"))  # k rows
