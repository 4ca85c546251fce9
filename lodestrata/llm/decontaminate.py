"""Operator 10: benchmark decontamination by winnowing, in DataFrame functions only.

Documents and items become arrays of lower-cased words (digits, ASCII letters
and everything beyond ASCII). Winnowing keeps, for every run of ``w``
consecutive k-gram hashes, the smallest; two texts that share ``w + k - 1``
words share a whole run of k-grams and so its minimum. With k = 4 and w = 7
every shared span of 10 words is found. Documents that hold an item's
fingerprint are candidates; their hits are extended to whole windows, compared
word for word, and the covered words are counted.

Array steps are separate columns on purpose: Spark keeps them as separate
projections, so a doubling step reads its input twice without computing it twice.

An item of fewer than 10 words is one window of its own length. Such lengths
(nine at most) get a pass of their own over the documents' n-grams of exactly
that length, since winnowing makes no promise for so short a span.

The item side is broadcast only when a count shows it to be small
(``BROADCAST_ROWS``); beyond that Spark joins by shuffle. Words of one document
are gathered per document only, so a passage that sits in a third of all
documents makes no hot group.

Defined cases: a null, empty or wordless text has no words and no hits; items
without words have no window; repeated items count once per item_id row value;
repeated or null ids are kept row by row; empty tables give no rows or no hits;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 10
K = 4
W = WINDOW - K + 1
BROADCAST_ROWS = 1_000_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` does just that on pure ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def words_of(c: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(c, F.lit(""))), SEPARATORS), "")


def _step(df: DataFrame, source: str, out: str, by: int, f) -> DataFrame:
    """Adds ``out`` = f(source[i], source[i + by]) for every i."""
    a = F.col(source)
    rest = F.greatest(F.size(a) - by, F.lit(0))
    return df.withColumn(out, F.zip_with(F.slice(a, F.lit(1), rest), F.slice(a, F.lit(1 + by), rest), f))


def _doubled(df: DataFrame, source: str, out: str, n: int, f) -> DataFrame:
    """Adds ``out`` = f folded over every run of n values of ``source``, doubling the run where possible."""
    done, current = 1, source
    while done < n:
        step = min(done, n - done)
        target = out if done + step == n else f"{out}_{done + step}"
        df = _step(df, current, target, step, f)
        current, done = target, done + step
    return df if current == out else df.withColumn(out, F.col(current))


def marks(df: DataFrame, words: str, lengths: list[int], keep: list[str]) -> DataFrame:
    """``keep`` and ``_marks``: winnowed fingerprints for length WINDOW, all n-gram hashes for shorter lengths."""
    df = df.withColumn("_h", F.transform(F.col(words), lambda x: F.xxhash64(x))).select(*keep, "_h")
    made = []
    for n in lengths:
        if n == WINDOW:
            df = _doubled(df, "_h", "_k", K, lambda x, y: F.xxhash64(x, y))
            df = _doubled(df, "_k", "_m", W, lambda x, y: F.least(x, y))
            made.append("_m")
        else:
            df = _doubled(df, "_h", f"_n{n}", n, lambda x, y: F.xxhash64(x, y))
            made.append(f"_n{n}")
    return df.select(*keep, F.array_distinct(F.concat(*made)).alias("_marks"))


def windows(df: DataFrame, words: str, n: int, keep: list[str]) -> DataFrame:
    """``keep``, at (position from 0) and window (the n words there joined by one space) for every start.

    Windows are joined by doubling, one array pass a step: linear in the text, however long.
    """
    joined = _doubled(df.select(*keep, F.col(words).alias("_w")), "_w", "_windows", n, lambda x, y: F.concat_ws(" ", x, y))
    # The outer form: a plain explode would push a filter on the array below the steps and compute them twice.
    return joined.select(*keep, F.posexplode_outer("_windows").alias("at", "window")).where(F.col("window").isNotNull())


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


@dataclass
class Hits:
    counted: DataFrame  # doc_id, text_key, n_words of every row
    hits: DataFrame  # doc_id, text_key, n, at, window: every occurrence of an item's window
    item_windows: DataFrame  # item_id, n, window
    n_windows: int
    n_candidates: int


def find_hits(docs: DataFrame, items: DataFrame) -> Hits | None:
    """Every window occurrence, or None if no item has a word."""
    bench = common.materialize(
        items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))
        .where(F.size("words") > 0)
        .withColumn("n", F.least(F.size("words"), F.lit(WINDOW)))
        .distinct(),
        "bench-words",
    )
    lengths = sorted(r["n"] for r in bench.select("n").distinct().collect())  # 1..WINDOW
    if not lengths:
        return None
    base = keyed_words(docs)
    item_windows = item_marks = None
    for n in lengths:
        own = bench.where(F.col("n") == n)
        w = windows(own, "words", n, ["item_id", "n"]).select("item_id", "n", "window")
        m = marks(own, "words", [n], []).select(F.explode("_marks").alias("mark"))
        item_windows = w if item_windows is None else item_windows.unionByName(w)
        item_marks = m if item_marks is None else item_marks.unionByName(m)
    item_windows = common.materialize(item_windows.distinct(), "bench-windows")
    n_windows = item_windows.count()
    item_marks = item_marks.distinct().withColumn("found", F.lit(True))

    # All documents: word counts and whether any mark is an item's.
    keyed = base.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_key", F.size("words").cast("long").alias("n_words"), "words")
    counted = (
        marks(keyed, "words", lengths, ["row", "doc_id", "text_key", "n_words"])
        .select("row", "doc_id", "text_key", "n_words", F.explode_outer("_marks").alias("mark"))
        .join(_small(item_marks, n_windows), "mark", "left")
        .groupBy("row", "doc_id", "text_key", "n_words")
        .agg(F.coalesce(F.max("found"), F.lit(False)).alias("maybe"))
        .drop("row")
    )
    counted = common.materialize(counted, "word-counts")
    n_candidates = counted.where("maybe").count()

    # Candidates only: extend to whole windows, word for word.
    texts = keyed_words(docs, counted.where("maybe"), n_candidates).dropDuplicates(["doc_id", "text_key"])
    known = _small(item_windows.select("n", "window").distinct(), n_windows)
    hits = None
    for n in lengths:
        own = windows(texts, "words", n, ["doc_id", "text_key"]).select("doc_id", "text_key", F.lit(n).alias("n"), "at", "window")
        hits = own if hits is None else hits.unionByName(own)
    hits = common.materialize(hits.join(known, ["n", "window"], "left_semi"), "window-hits")
    return Hits(counted, hits, item_windows, n_windows, n_candidates)


def keyed_words(docs: DataFrame, only: DataFrame | None = None, n_only: int = 0) -> DataFrame:
    """doc_id, text_key, words; with ``only``, of the rows whose keys it lists."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    if only is not None:
        rows = _matching(rows, only, n_only, "left_semi")
    return rows.select("doc_id", "text_key", words_of(F.col("text")).alias("words"))


def _matching(rows: DataFrame, keys: DataFrame, n_keys: int, how: str) -> DataFrame:
    wanted = _small(keys.select(F.col("doc_id").alias("_c_id"), F.col("text_key").alias("_c_key")).distinct(), n_keys)
    return rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("_c_id")) & (F.col("text_key") == F.col("_c_key")), how)


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``."""
    found = find_hits(docs, items)
    if found is None:
        return keyed_words(docs).select("doc_id", F.size("words").cast("long").alias("n_words"), *_answer(F.lit(None), F.lit(None)))
    hits = found.hits
    spans = (
        hits.groupBy("doc_id", "text_key")
        .agg(F.collect_list(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("spans"))
        .select("doc_id", "text_key", F.size(F.array_distinct(F.flatten("spans"))).cast("long").alias("hit"))
    )
    named = (
        hits.select("doc_id", "text_key", "n", "window")
        .distinct()
        .join(_small(found.item_windows, found.n_windows), ["n", "window"])
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set("item_id").alias("items"))
    )
    results = spans.join(named, [spans.doc_id.eqNullSafe(named.doc_id), spans.text_key == named.text_key]).select(
        spans.doc_id.alias("r_id"), spans.text_key.alias("r_key"), "hit", "items"
    )
    return found.counted.join(results, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_key") == F.col("r_key")), "left").select(
        "doc_id", "n_words", *_answer(F.col("hit"), F.col("items"))
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, with their columns as they are."""
    found = find_hits(docs, items)
    if found is None:
        return docs
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"))
    return _matching(rows, found.hits, found.n_candidates, "left_anti").select("_row.*")


def _answer(hit: Column, items: Column) -> list[Column]:
    names = F.coalesce(items.cast("array<string>"), F.array().cast("array<string>"))
    n_hit = F.coalesce(hit.cast("long"), F.lit(0).cast("long"))
    return [
        n_hit.alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(names), ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    ]


_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bn AS (SELECT item_id, w, least(len(w), {WINDOW}) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT *, unnest(generate_series(1, len(w) - n + 1)) AS i FROM bn)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bn) WHERE len(w) >= n)),
h AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',')) AS items_sha256 FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
