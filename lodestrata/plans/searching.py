"""Search by index and with arguments: full text, fused with vectors, with citations; codes by name and by range; tools."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stemming
from ..operators import fulltext, naming, retrieval
from ..sources.tables import load
from .registry import query

_STOP = ", ".join(f"'{w}'" for w in stemming.STOP_WORDS)
_CUT = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+')"
_TOKENS = f"""f AS (SELECT doc_id, {_CUT.format("split_part(text, '.', 1)")} AS a, {_CUT.format("source")} AS b, {_CUT.format("text")} AS c FROM documents),
tok AS (SELECT doc_id, unnest(a) AS word, generate_subscripts(a, 1) AS pos, 1.0 AS weight FROM f UNION ALL SELECT doc_id, unnest(b), len(a) + generate_subscripts(b, 1), 0.4 FROM f
UNION ALL SELECT doc_id, unnest(c), len(a) + len(b) + generate_subscripts(c, 1), 0.2 FROM f),
words AS (SELECT DISTINCT word FROM tok WHERE word NOT IN ({_STOP})), {stemming.stem_sql("words", "stems")}, hit AS (SELECT doc_id, stem, pos, weight FROM tok JOIN stems USING (word))"""
_indexes: dict[tuple[str, str], fulltext.Index] = {}


def document_index(spark, sf) -> fulltext.Index:
    """The documents' index, built once an application and folder: first sentence, source and text."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _indexes:
        fields = [(F.substring_index("text", ".", 1), "A"), (F.col("source"), "B"), (F.col("text"), "C")]
        _indexes[key] = fulltext.build(load(spark, sf, "documents"), "doc_id", fields)
    return _indexes[key]


QUESTION = 'erons erth -thation or "thnt the eron" or ntly ereds or "a un"'


@query(f"""WITH {_TOKENS},
h AS (SELECT doc_id, stem, pos, CASE WHEN stem <> 'thation' THEN 1 / weight END AS cost FROM hit WHERE stem IN ('eron', 'erth', 'thation', 'thnt', 'ntli', 'ere', 'un')),
h2 AS (SELECT *, count(cost) OVER (PARTITION BY doc_id ORDER BY pos) AS n, sum(cost) OVER (PARTITION BY doc_id ORDER BY pos) AS costs, bool_or(stem = 'thation') OVER (PARTITION BY doc_id) AS bad FROM h),
p AS (SELECT h.doc_id, h.pos, s.n AS start FROM h2 h JOIN h2 s ON s.doc_id = h.doc_id AND h.stem = 'eron' AND s.stem = 'thnt' AND s.pos = h.pos - 2),
l AS (SELECT h2.*, max(CASE WHEN stem = 'eron' THEN n END) OVER w AS eron, max(CASE WHEN stem = 'erth' THEN n END) OVER w AS erth, max(p.start) OVER w AS phrase, max(CASE WHEN stem = 'ntli' THEN n END) OVER w AS ntly,
max(CASE WHEN stem = 'ere' THEN n END) OVER w AS ered, max(CASE WHEN stem = 'un' THEN n END) OVER w AS un FROM h2 LEFT JOIN p USING (doc_id, pos) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
g AS (SELECT *, greatest(CASE WHEN NOT bad AND eron IS NOT NULL AND erth IS NOT NULL THEN least(eron, erth) END, phrase, CASE WHEN ntly IS NOT NULL AND ered IS NOT NULL THEN least(ntly, ered) END, un) AS start FROM l),
c AS (SELECT *, start > coalesce(max(start) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fresh FROM g),
s AS (SELECT c.doc_id, sum((c.n - b.n + 1) / (c.costs - b.costs + b.cost) / (1 + greatest(c.pos - b.pos + 1 - (c.n - b.n + 1), 0))) AS rank FROM c JOIN h2 b ON b.doc_id = c.doc_id AND b.n = c.start AND b.cost IS NOT NULL WHERE c.fresh GROUP BY c.doc_id)
SELECT doc_id, round(rank, 9) AS rank FROM s""")
def fulltext_search(spark, sf):
    found = fulltext.search(document_index(spark, sf), QUESTION)
    return found.select("doc_id", F.round("rank", 9).alias("rank"))


@query(f"""WITH {_TOKENS}, st AS (SELECT count(*) AS n, avg(len(a) + len(b) + len(c)) AS mean FROM f), q AS (SELECT * FROM (VALUES ('eron', 2), ('erth', 1), ('src3', 1)) q(stem, times)),
tf AS (SELECT doc_id, stem, count(*) AS tf, bool_or(weight = 0.4) AS headed FROM hit JOIN q USING (stem) GROUP BY ALL), df AS (SELECT stem, count(*) AS df FROM tf GROUP BY stem)
SELECT doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * (len(a) + len(b) + len(c)) / mean))) + CASE WHEN bool_or(headed) THEN 0.75 ELSE 0 END, 8) AS score
FROM tf JOIN df USING (stem) JOIN q USING (stem) JOIN f USING (doc_id), st GROUP BY doc_id""")
def bm25_indexed(spark, sf):
    return fulltext.bm25(document_index(spark, sf), ["eron", "erth", "src3", "eron"]).select("doc_id", F.round("score", 8).alias("score"))


@query(f"""WITH {_TOKENS}, t AS (SELECT doc_id, list(DISTINCT stem) AS stems FROM hit GROUP BY doc_id), h AS (SELECT doc_id, stem, pos, 1 / weight AS cost FROM hit JOIN t USING (doc_id) WHERE stem IN ('eron', 'erth') AND list_contains(stems, 'eron') AND list_contains(stems, 'erth')),
h2 AS (SELECT *, count(*) OVER w AS n, sum(cost) OVER w AS costs, max(CASE WHEN stem = 'eron' THEN pos END) OVER w AS pe, max(CASE WHEN stem = 'erth' THEN pos END) OVER w AS pt FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
c AS (SELECT doc_id, pos, n, costs, least(pe, pt) AS start, lag(CASE WHEN pe IS NOT NULL AND pt IS NOT NULL THEN least(pe, pt) END) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM h2 WHERE pe IS NOT NULL AND pt IS NOT NULL),
s AS (SELECT c.doc_id, sum((c.n - b.n + 1) / (c.costs - b.costs + b.cost) / (1 + greatest(c.pos - b.pos + 1 - (c.n - b.n + 1), 0))) AS rank FROM c JOIN h2 b ON b.doc_id = c.doc_id AND b.pos = c.start WHERE c.before IS NULL OR c.start > c.before GROUP BY c.doc_id),
l AS (SELECT doc_id, row_number() OVER (ORDER BY rank DESC, doc_id) AS r FROM s), vec AS (SELECT v.vec_id AS doc_id, row_number() OVER (ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, v.vec_id) AS r FROM embeddings v JOIN documents d ON d.doc_id = v.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 11) q),
u AS (SELECT coalesce(v.doc_id, l.doc_id) AS doc_id, v.r AS vector_rank, l.r AS lexical_rank, round(coalesce(0.55 / (60 + v.r), 0) + coalesce(0.45 / (60 + l.r), 0), 10) AS score FROM (SELECT * FROM vec WHERE r <= 48) v FULL OUTER JOIN (SELECT * FROM l WHERE r <= 48) l ON v.doc_id = l.doc_id),
k AS (SELECT l_orderkey AS doc_id, arg_min(l_partkey, (CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 5 END, l_partkey)) AS target FROM lineitem GROUP BY l_orderkey)
SELECT u.doc_id, coalesce(p.p_partkey, u.doc_id) AS citation_id, coalesce(p.p_name, d.source) AS citation_title, vector_rank, lexical_rank, score FROM u JOIN documents d USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN part p ON p.p_partkey = k.target ORDER BY score DESC, u.doc_id LIMIT 12""")
def hybrid_cited(spark, sf):
    kind = F.when(F.col("l_returnflag") == "A", "SOURCE").when(F.col("l_returnflag") == "N", "DOCUMENT").otherwise("ENTITY")
    links = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), kind.alias("link_type"), F.col("l_partkey").alias("target"))
    nodes = load(spark, sf, "part").select(F.col("p_partkey").alias("target"), F.col("p_name").alias("title"))
    vectors = load(spark, sf, "embeddings")
    own = vectors.withColumnRenamed("vec_id", "doc_id").join(load(spark, sf, "documents"), "doc_id", "left_semi")
    asked = vectors.where("vec_id = 11").select(F.col("embedding").alias("q"))
    chunks = load(spark, sf, "documents").select("doc_id", F.col("source").alias("title"))
    found = retrieval.hybrid(document_index(spark, sf), chunks, own, "erons erth", asked, links, nodes, limit=12)
    return found.select("doc_id", "citation_id", "citation_title", "vector_rank", "lexical_rank", F.round("score", 10).alias("score")).orderBy(F.desc("score"), "doc_id")


@query(r"""WITH body AS (SELECT row_number() OVER () AS x, l_orderkey * 10 + l_linenumber AS passage, l_partkey AS paper, 'stations LX' || l_linenumber || CASE WHEN l_quantity > 25 THEN ' – LX' ELSE '-' END || l_quantity::INTEGER || ', part P-' || l_suppkey || '; near ' || l_linestatus || l_returnflag || l_linenumber AS body FROM lineitem),
t AS (SELECT unnest(['LX5', 'LX12', 'P-7', 'ON2', 'LX40']) AS term), r AS (SELECT term, regexp_extract(term, '^([A-Z]+)', 1) AS prefix, regexp_extract(term, '([0-9]+)$', 1)::INTEGER AS num FROM t WHERE regexp_matches(term, '^[A-Z]+[0-9]+$')),
hit AS (SELECT passage, paper, term, (length(body) - length(replace(body, term, ''))) // length(term) AS n FROM body, t WHERE regexp_matches(body, '(^|[^A-Za-z0-9])' || term || '($|[^A-Za-z0-9])')
UNION ALL SELECT passage, paper, term, 1 FROM body, r WHERE prefix = 'LX' AND num BETWEEN regexp_extract(body, 'LX([0-9]+)', 1)::INTEGER AND regexp_extract(body, '[-–] ?(?:LX)?([0-9]+),', 1)::INTEGER AND regexp_extract(body, 'LX([0-9]+)', 1)::INTEGER < regexp_extract(body, '[-–] ?(?:LX)?([0-9]+),', 1)::INTEGER),
c AS (SELECT passage, paper, sum(n)::BIGINT AS n, list_sort(list(DISTINCT term)) AS terms FROM hit GROUP BY passage, paper),
p AS (SELECT paper, count(*) AS passages, arg_min(passage, (-n, passage)) AS best, list_sort(list_distinct(flatten(list(terms)))) AS named FROM c GROUP BY paper)
SELECT paper, passages, best, array_to_string(named, ',') AS named FROM p ORDER BY len(named) DESC, passages DESC, paper LIMIT 20""")
def papers_naming_ranges(spark, sf):
    dash = F.when(F.col("l_quantity") > 25, " – LX").otherwise("-")
    body = F.concat(F.lit("stations LX"), "l_linenumber", dash, F.col("l_quantity").cast("int"), F.lit(", part P-"), "l_suppkey", F.lit("; near "), "l_linestatus", "l_returnflag", "l_linenumber")
    passages = load(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("passage"), F.col("l_partkey").alias("paper"), body.alias("body"))
    found = naming.papers_naming(passages, ["LX5", "LX12", "P-7", "ON2", "LX40", "no good code"], "passage", "paper", "body", limit=20)
    return found.select("paper", "passages", "best", F.array_join("named", ",").alias("named"))


@query(f"""WITH d AS (SELECT doc_id, text FROM documents WHERE source IN ('src1', 'src2', 'src3')), f AS (SELECT doc_id, {_CUT.format("text")} AS c FROM d), tok AS (SELECT DISTINCT doc_id, unnest(c) AS word FROM f),
words AS (SELECT DISTINCT word FROM tok), {stemming.stem_sql("words", "stems")}, m AS (SELECT DISTINCT doc_id, stem FROM tok JOIN stems USING (word) WHERE stem IN ('thation', 'eron', 'erth')), n AS (SELECT count(*) AS n FROM d),
w AS (SELECT stem, ln((n + 1.0) / (count(*) + 0.5)) AS idf FROM m, n GROUP BY stem, n), s AS (SELECT doc_id, sum(idf) AS score FROM m JOIN w USING (stem) GROUP BY doc_id), l AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 12) DESC, doc_id) AS r FROM s),
v AS (SELECT d.doc_id, row_number() OVER (ORDER BY round(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12) NULLS LAST, d.doc_id) AS r FROM d LEFT JOIN embeddings e ON e.vec_id = d.doc_id, (SELECT embedding FROM embeddings WHERE vec_id = 11) q)
SELECT v.doc_id, v.r AS vector_rank, l.r AS lexical_rank, round(0.4 / (60 + v.r) + coalesce(0.6 / (60 + l.r), 0), 10) AS score FROM v LEFT JOIN l USING (doc_id) ORDER BY score DESC, v.doc_id LIMIT 30""")
def paper_passages(spark, sf):
    scope = load(spark, sf, "documents").where("source IN ('src1', 'src2', 'src3')").select("doc_id")
    vectors = load(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")
    asked = vectors.where("doc_id = 11").select(F.col("embedding").alias("q"))
    found = retrieval.passages(document_index(spark, sf), scope, vectors, "the thation of erons and erth", asked, limit=30, field="C")
    return found.select("doc_id", "vector_rank", "lexical_rank", F.round("score", 10).alias("score")).orderBy(F.desc("score"), "doc_id")
