"""Lexical, vector and hybrid ranking over (id, text) and (id, vector) tables.

A query is small and its terms travel as literals; the corpus is only ever
aggregated by id or by term. Nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine, search_tokens
from ..sources.shared import materialize

#: Rows of a side that is broadcast, at most; its count is taken first.
BROADCAST_ROWS = 1_000_000


def _equals(term: str):
    return lambda x: x == F.lit(term)


def bm25(docs: DataFrame, terms: list[str], id_: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of documents with score above 0; a repeated query term counts again.

    One pass gives each document's length and term frequencies (term counts of a
    handful of literals are columns, not rows), written once so that the corpus is
    read and cut into words once; corpus figures are one row.
    """
    distinct = sorted(set(terms))
    counted = docs.select(F.col(id_), search_tokens(F.col(text)).alias("_t")).select(
        id_, F.size("_t").alias("dl"), *[F.size(F.filter("_t", _equals(q))).alias(f"tf{i}") for i, q in enumerate(distinct)]
    )
    counted = materialize(counted, "postings")
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(distinct))])
    score = F.lit(0.0)
    for i, q in enumerate(distinct):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        score = score + terms.count(q) * F.when(tf > 0, part).otherwise(0.0)
    return counted.crossJoin(F.broadcast(stats)).select(id_, score.alias("score")).where("score > 0")


def nearest_vectors(vectors: DataFrame, query: Column, k: int, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows of largest cosine similarity, ties to the smaller id, with their rank."""
    scored = vectors.select(id_, cosine(F.col(vector), query).alias("similarity")).orderBy(F.desc("similarity"), id_).limit(k)
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), id_)).cast("long"))  # k rows


def ranked(scores: DataFrame, id_: str, k: int) -> DataFrame:
    """The k best by score with their rank."""
    top = scores.orderBy(F.desc("score"), id_).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_)).cast("long"))  # k rows


def route(tools: DataFrame, text: str, wanted: list[str], weights: dict[str, int], limit: int, ties: list[str]) -> DataFrame:
    """Tools whose words hold all of ``wanted``, by the weights of the words they hold, ties by ``ties``; 1 to 20 rows."""
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), " ")
    score = sum((F.array_contains(words, w).cast("int") * n for w, n in weights.items()), F.lit(0))
    fit = [F.array_contains(words, w) for w in wanted]
    found = tools.where(reduce(lambda a, b: a & b, fit, F.lit(True))).withColumn("score", score)
    return found.orderBy(F.desc("score"), *ties).limit(max(1, min(limit, 20)))


def fuse(lists: list[tuple[DataFrame, float]], id_: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: sum of weight / (k + rank) over ranked lists, weights clamped to [0, 1]."""
    parts = [df.select(id_, (F.lit(max(0.0, min(1.0, w))) / (k + F.col("rank"))).alias("part")) for df, w in lists]
    return reduce(DataFrame.unionByName, parts).groupBy(id_).agg(F.sum("part").alias("score"))


def fuse_two(first: DataFrame, second: DataFrame, id_: str, w1: float, w2: float, k: int = 60) -> DataFrame:
    """Fusion of a vector list and a lexical list by full outer join, with both ranks kept."""
    a = first.select(id_, F.col("rank").alias("vector_rank"))
    b = second.select(id_, F.col("rank").alias("lexical_rank"))
    score = F.coalesce(w1 / (k + F.col("vector_rank")), F.lit(0.0)) + F.coalesce(w2 / (k + F.col("lexical_rank")), F.lit(0.0))
    return a.join(b, id_, "full_outer").withColumn("score", score)


#: Which of a chunk's links is its citation.
CITED_FIRST = {"SOURCE": 1, "DOCUMENT": 2, "PAGE": 3, "PARENT": 4}


def cited(found: DataFrame, links: DataFrame, nodes: DataFrame, id_: str) -> DataFrame:
    """``found`` with target and title of each row's first link by kind, then by target; without a link both are null."""
    place = F.coalesce(*[F.when(F.col("link_type") == k, v) for k, v in CITED_FIRST.items()], F.lit(5))
    own = links.join(F.broadcast(found.select(id_)), id_, "left_semi")  # found is a page of results
    first = own.groupBy(id_).agg(F.min_by("target", F.struct(place, "target")).alias("target"))
    named = nodes.select("target", F.col("title").alias("cited_title")).join(F.broadcast(first), "target")
    return found.join(named, id_, "left")


def hybrid(
    index, chunks: DataFrame, vectors: DataFrame, question: str, vector: DataFrame, links: DataFrame, nodes: DataFrame,
    limit: int | None = 12, only: Column | None = None, lexical_weight: float | None = 0.45, vector_weight: float | None = 0.55,
) -> DataFrame:
    """Full text by cover density and vectors by cosine, fused by reciprocal ranks, each hit with its citation.

    ``vector`` is one row with a column q. ``only`` restricts the chunks. 1 to 50 rows, ties to the smaller id; four times
    as many of each list enter the fusion. A weight that is null is its default; weights are clamped to [0, 1].
    """
    from . import fulltext

    id_ = index.id
    n = max(1, min(12 if limit is None else limit, 50))
    weights = [max(0.0, min(1.0, d if w is None else w)) for w, d in ((vector_weight, 0.55), (lexical_weight, 0.45))]
    allowed = chunks if only is None else chunks.where(only)
    lexical, near = fulltext.search(index, question), vectors
    if only is not None:
        lexical, near = (df.join(allowed.select(id_), id_, "left_semi") for df in (lexical, near))
    lexical = fulltext.best(lexical, id_, "rank", 4 * n)
    near = nearest_vectors(near.crossJoin(F.broadcast(vector.limit(1))), F.col("q"), 4 * n, id_)
    fused = fuse_two(near, lexical, id_, *weights).orderBy(F.desc(F.round("score", 10)), id_).limit(n)
    fused = materialize(fused, "fused")  # a page of results, joined three times
    page = chunks.join(F.broadcast(fused), id_)
    out = cited(page, links, nodes, id_)
    return out.select(*page.columns, F.coalesce("target", id_).alias("citation_id"), F.coalesce("cited_title", "title").alias("citation_title"))


def exact_ranks(rows: DataFrame, id_: str, score: str, asked: DataFrame) -> DataFrame:
    """id and rank (from 1) of the ``asked`` ids among all rows by falling score, null last, ties to the smaller id.

    The asked rows' scores cut the rows into classes; classes are counted and added up, so no row but the asked ones is sorted.
    """
    key = F.struct(F.col(score).isNull().alias("none"), (-F.col(score)).alias("less"), F.col(id_).alias("id"))
    keyed = rows.select(F.col(id_), key.alias("key"))
    own = keyed.join(F.broadcast(asked.select(id_)), id_, "left_semi")
    bounds = own.agg(F.array_sort(F.collect_list("key")).alias("bounds"))  # as many as are asked for
    below = F.size(F.filter("bounds", lambda b: b < F.col("key")))
    counts = keyed.crossJoin(F.broadcast(bounds)).groupBy(below.alias("place")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("rank", F.sum("n").over(before)).select("place", "rank")  # a row for each asked one
    places = own.crossJoin(F.broadcast(bounds)).select(id_, (F.array_position("bounds", F.col("key")) - 1).cast("int").alias("place"))
    return places.join(F.broadcast(upto), "place").select(id_, "rank")


def passages(index, scope: DataFrame, vectors: DataFrame, question: str, vector: DataFrame, limit: int | None = 12, field: str | None = None) -> DataFrame:
    """The passages of ``scope`` (its ids), by vector and by any of the question's stems, the rarer in the scope the more; 1 to 30 rows.

    A passage scores 0.4 / (60 + its place by vector) + 0.6 / (60 + its place by words). A row in neither list's
    first ``enough`` cannot reach the page, so only those rows' places are counted out.
    """
    from ..functions import stemming
    from . import fulltext

    id_ = index.id
    n = max(1, min(12 if limit is None else limit, 30))
    groups = fulltext.stemmed(index.spark, fulltext.alternatives(question.replace('"', " ").replace("-", " ")))
    stems = sorted({w for group in groups for item in group for w in item.words})
    held = index.of(stems)
    if field is not None:
        held = held.where(F.exists("places", lambda p: p["weight"] == fulltext.WEIGHTS[field]))
    found = materialize(held.select(id_, "stem").distinct().join(scope, id_, "left_semi"), "scoped")
    size = scope.agg(F.count(F.lit(1)).alias("size"))
    idf = found.groupBy("stem").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(size)).select("stem", F.log((F.col("size") + 1.0) / (F.col("df") + 0.5)).alias("idf"))
    lexical = found.join(F.broadcast(idf), "stem").groupBy(id_).agg(F.round(F.sum("idf"), 12).alias("score"))  # a row a stem is broadcast
    near = scope.join(vectors, id_, "left").crossJoin(F.broadcast(vector.limit(1)))
    near = near.select(id_, F.round(cosine(F.col("embedding"), F.col("q")), 12).alias("score"))
    # The last of the page has place n by words or n by vector at worst: 0.4 / (60 + n), which a row past place m in both beats only if 1 / (60 + m) is more.
    enough = int(2.5 * (60 + n)) + 1
    asked = lexical.orderBy(F.desc("score"), id_).limit(enough).select(id_).union(near.orderBy(F.desc_nulls_last("score"), id_).limit(enough).select(id_)).distinct()
    asked = materialize(asked, "asked")
    by_vector = exact_ranks(near, id_, "score", asked).withColumnRenamed("rank", "vector_rank")
    by_word = exact_ranks(lexical, id_, "score", asked).withColumnRenamed("rank", "lexical_rank")
    out = by_vector.join(by_word, id_, "left")
    score = 0.4 / (60 + F.col("vector_rank")) + F.coalesce(0.6 / (60 + F.col("lexical_rank")), F.lit(0.0))
    return out.withColumn("score", score).orderBy(F.desc(F.round("score", 10)), id_).limit(n)
