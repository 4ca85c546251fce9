"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The stop words of lexical search.
STOP_WORDS = (
    "a an and are as at be by for from has have how in is it of on or that the their this to "
    "was were what when where which who why with"
).split()
WORD = "[A-Za-z0-9][A-Za-z0-9'_-]*"


def search_tokens(text: Column) -> Column:
    """Lower-cased words of two characters or more without stop words, in order, with repeats."""
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1), lambda x: F.lower(x))
    return F.filter(found, lambda x: (F.length(x) > 1) & ~x.isin(STOP_WORDS))


def plain_words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def sliding_chunks(words: Column, size: int, overlap: int) -> Column:
    """Runs of ``size`` words that share ``overlap`` words with the one before; the last one ends the text."""
    step = size - overlap
    n = F.size(words)
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(float(step)))).cast("int") * step
    starts = F.when(n > 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, size), " "))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / (norm(a) * norm(b))


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def stable_id(prefix: str, *parts: Column) -> Column:
    """Prefix and the first 20 hex digits of the SHA-256 of the parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 20))


def normal_url(url: Column) -> Column:
    """https, lower-case host without www., no fragment, the query kept, '/' for an empty path."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, "^[A-Za-z]+://([^/?#]*)", 1)), r"^www\.", "")
    path = F.regexp_extract(url, "^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    asked = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return F.concat(F.lit("https://"), host, F.when(path == "", "/").otherwise(path), asked)


def spread(df: DataFrame, keep: list[str], array: Column, name: str) -> DataFrame:
    """One row per array element.

    A plain explode makes the optimizer infer a filter on the array's size and push
    it below the projections, where the array's own inputs would be computed again
    for every element; the outer form with a filter on the element does not.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def shingle_sets(df: DataFrame, keep: list[str], words: str, n: int, name: str) -> DataFrame:
    """``keep`` and the distinct runs of ``n`` words as an array of 64-bit hashes; empty for shorter texts. A filter on
    the array would be pushed below the steps and compute each of them again, several times over.

    Words are hashed once and runs by doubling, so no run is ever a string. Two of N runs
    share a hash by chance with probability N / 2^64, under one in a million for 10^13 runs.
    """
    df = df.withColumn(f"_{name}1", F.transform(F.col(words), lambda w: F.xxhash64(w))).select(*keep, f"_{name}1")
    done, current = 1, f"_{name}1"
    while done < n:
        step = min(done, n - done)
        rest = F.greatest(F.size(current) - step, F.lit(0))
        target = f"_{name}{done + step}"
        df = df.withColumn(target, F.zip_with(F.slice(current, F.lit(1), rest), F.slice(current, F.lit(1 + step), rest), lambda x, y: F.xxhash64(x, y)))
        current, done = target, done + step
    return df.select(*keep, F.coalesce(F.array_distinct(current), F.array().cast("array<bigint>")).alias(name))


def shingle_hashes(df: DataFrame, keep: list[str], words: str, n: int, name: str) -> DataFrame:
    """The hashes of ``shingle_sets``, one row each."""
    return spread(shingle_sets(df, keep, words, n, f"_{name}"), keep, F.col(f"_{name}"), name)


def shingle_rows(df: DataFrame, keep: list[str], words: str, n: int, name: str) -> DataFrame:
    """Distinct runs of ``n`` words, space-joined, one row each; none for shorter texts.

    Runs are joined by doubling, one array pass a step, so the cost grows with the
    text's length and not with its square.
    """
    done, current = 1, words
    while done < n:
        step = min(done, n - done)
        rest = F.greatest(F.size(current) - step, F.lit(0))
        target = f"_{name}{done + step}"
        df = df.withColumn(target, F.zip_with(F.slice(current, F.lit(1), rest), F.slice(current, F.lit(1 + step), rest), lambda x, y: F.concat_ws(" ", x, y)))
        current, done = target, done + step
    return spread(df.select(*keep, F.array_distinct(current).alias(f"_{name}")), keep, F.col(f"_{name}"), name)
