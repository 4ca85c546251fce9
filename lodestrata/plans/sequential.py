"""Queries whose operators SQL cannot express, and fuzzy and question-text forms that it can."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking, joins, sites
from ..sources.tables import load
from .registry import query

_CUT = """CASE WHEN {a} + 450 >= n THEN n ELSE coalesce(list_max(list_filter(generate_series({a} + 371, {a} + 450), lambda i: right(w[i], 1) IN ('.', '!', '?', ':', ';', ')'))), {a} + 450) END"""


@query(rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r]+') AS w FROM documents), e AS (SELECT doc_id, w, len(w) AS n FROM d WHERE len(w) > 650),
c(doc_id, chunk, a, b) AS (SELECT doc_id, 0::BIGINT, 0::BIGINT, {_CUT.format(a=0)} FROM e UNION ALL SELECT doc_id, chunk + 1, a, {_CUT.format(a='a')} FROM (SELECT c.doc_id, chunk, greatest(c.a + 1, c.b - 60) AS a, w, n FROM c JOIN e USING (doc_id) WHERE c.b < n))
SELECT doc_id, chunk, md5(array_to_string(w[a + 1:b], ' ')) AS digest FROM c JOIN e USING (doc_id) UNION ALL SELECT doc_id, 0, md5(array_to_string(w, ' ')) FROM d WHERE len(w) BETWEEN 1 AND 650""")
def sentence_chunks(spark, sf):
    words = F.regexp_extract_all("text", F.lit(r"([^ \t\n\r]+)"), 1)
    d = load(spark, sf, "documents").select("doc_id", words.alias("w"))
    c = d.select("doc_id", F.posexplode_outer(chunking.sentence_chunks(F.col("w"))).alias("chunk", "body")).where("body IS NOT NULL")
    return c.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.md5("body").alias("digest"))


# Lines become blocks, and lines that begin with A to E become headings.
_BLOCKS = r"regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '\n\n([A-E])', chr(10) || chr(10) || '# \1', 'g')"


@query(rf"""WITH RECURSIVE b AS (SELECT doc_id, source, unnest(x) AS block, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, source, string_split({_BLOCKS}, chr(10) || chr(10)) AS x FROM documents)),
h AS (SELECT *, sum(starts_with(block, '#')::INT) OVER w AS section, coalesce(last_value(CASE WHEN starts_with(block, '#') THEN trim(regexp_replace(block, '^[# ]+', '')) END IGNORE NULLS) OVER w, source) AS heading FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
s AS (SELECT doc_id, section, heading, flatten(list(regexp_extract_all(block, '[^ \t\n\r]+') ORDER BY pos)) AS w FROM h WHERE NOT starts_with(block, '#') GROUP BY ALL),
t AS (SELECT doc_id, section, heading, w, unnest(generate_series(0, greatest(0, ceil((len(w) - 520) / 470.0)::BIGINT) * 470, 470)) AS a FROM s WHERE len(w) > 0),
u AS (SELECT doc_id, heading, 1 + len(regexp_extract_all(heading, '[^ \t\n\r]+')) + len(w[a + 1:a + 520]) AS n, '## ' || heading || chr(10) || chr(10) || array_to_string(w[a + 1:a + 520], ' ') AS body, row_number() OVER (PARTITION BY doc_id ORDER BY section, a) AS i FROM t),
p(doc_id, i, part, held) AS (SELECT doc_id, i, 0, n FROM u WHERE i = 1 UNION ALL SELECT u.doc_id, u.i, CASE WHEN held + n > 600 THEN part + 1 ELSE part END, CASE WHEN held + n > 600 THEN n ELSE held + n END FROM p JOIN u ON u.doc_id = p.doc_id AND u.i = p.i + 1)
SELECT u.doc_id, part AS chunk, sum(n)::BIGINT AS words, count(DISTINCT heading) AS headings, md5(string_agg(body, chr(10) || chr(10) ORDER BY u.i)) AS digest FROM u JOIN p ON u.doc_id = p.doc_id AND u.i = p.i GROUP BY u.doc_id, part""")
def heading_chunks(spark, sf):
    blocks = F.regexp_replace(F.replace("text", F.lit("\n"), F.lit("\n\n")), "\n\n([A-E])", "\n\n# $1")
    c = chunking.heading_chunks(load(spark, sf, "documents").select("doc_id", "source", blocks.alias("blocks")), "doc_id", "blocks", "source")
    return c.select("doc_id", "chunk", "words", F.size("headings").cast("long").alias("headings"), F.md5("body").alias("digest"))


@query()
def site_clusters(spark, sf):
    k = F.col("s_suppkey")
    code = F.when(k % 3 > 0, F.concat(F.lit("S"), (k % 3).cast("string")))
    return sites.cluster_sites(load(spark, sf, "supplier").select(k.cast("long").alias("id"), (45 + k * 7 % 50 * 0.001).alias("lat"), (-130 + k * 13 % 50 * 0.001).alias("lon"), code.alias("code")))


@query("""WITH p AS (SELECT p_partkey, p_brand, p_size, lower(p_name || ' ' || p_type) AS title FROM part) SELECT a.p_partkey AS a, b.p_partkey AS b, round(1 - levenshtein(a.title, b.title) * 1.0 / greatest(length(a.title), length(b.title)), 6) AS ratio
FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey WHERE 1 - levenshtein(a.title, b.title) * 1.0 / greatest(length(a.title), length(b.title)) >= 0.6""")
def fuzzy_title_join(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", "p_brand", "p_size", F.lower(F.concat("p_name", F.lit(" "), "p_type")).alias("title"))
    return joins.similar_titles(p, "p_partkey", ["p_brand", "p_size"], "title", 0.6).select("a", "b", F.round("ratio", 6).alias("ratio"))


@query(r"""WITH q AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[^.?!]+[.?!]')) AS part FROM conversations) SELECT conv_id, turn, count(*) AS parts, max(length(trim(part)))::BIGINT AS longest FROM q GROUP BY ALL""")
def question_parts(spark, sf):
    q = load(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit("([^.?!]+[.?!])"), 1)).alias("part"))
    return q.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("parts"), F.max(F.length(F.trim("part"))).cast("long").alias("longest"))


@query(r"""WITH w AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(text, '[A-Za-z0-9]{4,}')) AS word FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY regexp_matches(word, '[0-9]') DESC, regexp_matches(word, '^[A-Z]') DESC, length(word) DESC, word) AS k FROM w)
SELECT conv_id, turn, k, word FROM r WHERE k <= 6""")
def distinctive_words(spark, sf):
    w = load(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9]{4,})"), 1)).alias("word")).distinct()
    order = [F.col("word").rlike("[0-9]").desc(), F.col("word").rlike("^[A-Z]").desc(), F.desc(F.length("word")), "word"]
    return joins.top_per_group(w, ["conv_id", "turn"], order, 6, "k").select("conv_id", "turn", "k", "word")


@query("""WITH d AS (SELECT c_custkey, DATE '2024-01-01' + CAST(c_custkey % 366 AS INTEGER) AS day FROM customer) SELECT c_custkey, epoch(day)::BIGINT + 3600 * CASE WHEN day > DATE '2024-03-10' AND day <= DATE '2024-11-03' THEN 7 ELSE 8 END AS opens,
(86400 + CASE WHEN day = DATE '2024-03-10' THEN -3600 WHEN day = DATE '2024-11-03' THEN 3600 ELSE 0 END)::BIGINT AS seconds FROM d""")
def local_day_window(spark, sf):
    """The UTC span of a local day on the US west coast, whatever the session's zone."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 366).cast("int"))
    at = lambda d: F.unix_timestamp(F.make_timestamp(F.year(d), F.month(d), F.day(d), F.lit(0), F.lit(0), F.lit(0), F.lit("America/Los_Angeles")))
    return load(spark, sf, "customer").select("c_custkey", at(day).alias("opens"), (at(F.date_add(day, 1)) - at(day)).alias("seconds"))
