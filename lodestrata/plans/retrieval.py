"""Search, ranking, graph walks, evidence and evaluation over documents, embeddings and the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import graph, joins, retrieval, runs
from ..sources.shared import materialize
from ..sources.tables import load
from .registry import query

TERMS = ["thation", "eron", "erth", "thnt", "eron"]
_IN = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_TOKENS = f"list_filter(list_transform(regexp_extract_all(text, '{tx.WORD.replace(chr(39), chr(39) * 2)}'), lambda x: lower(x)), lambda x: length(x) > 1 AND x NOT IN ({_IN}))"
_BM25 = f"""tok AS (SELECT doc_id, {_TOKENS} AS t FROM documents), q AS (SELECT unnest(['thation', 'eron', 'erth', 'thnt', 'eron']) AS term), qc AS (SELECT term, count(*) AS times FROM q GROUP BY term),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok), tf AS (SELECT doc_id, len(t) AS dl, term, times, len(list_filter(t, lambda x: x = term)) AS tf FROM tok, qc),
df AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY term),
bm AS (SELECT doc_id, sum(CASE WHEN tf > 0 THEN times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END) AS score FROM tf JOIN df USING (term), st GROUP BY doc_id)"""
_VEC = "vec AS (SELECT v.vec_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS similarity FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 7) q)"


def _probe(spark, sf) -> DataFrame:
    """The vectors beside the query vector (row 7), which travels as one broadcast row."""
    v = load(spark, sf, "embeddings")
    q = v.where("vec_id = 7").select(F.col("embedding").alias("q")).limit(1)
    return v.crossJoin(F.broadcast(q))


@query(f"WITH {_BM25} SELECT doc_id, round(score, 8) AS score FROM bm WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50")
def bm25_search(spark, sf):
    return retrieval.ranked(retrieval.bm25(load(spark, sf, "documents"), TERMS), "doc_id", 50).select("doc_id", F.round("score", 8).alias("score"))


@query(f"WITH {_VEC} SELECT vec_id, round(similarity, 8) AS similarity, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank FROM vec ORDER BY similarity DESC, vec_id LIMIT 40")
def vector_search(spark, sf):
    return retrieval.nearest_vectors(_probe(spark, sf), F.col("q"), 40).select("vec_id", F.round("similarity", 8).alias("similarity"), "rank")


@query(f"""WITH {_BM25}, {_VEC}, l AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM bm WHERE score > 0), v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY similarity DESC, vec_id) AS r FROM vec)
SELECT coalesce(v.id, l.id) AS doc_id, v.r AS vector_rank, l.r AS lexical_rank, round(coalesce(0.55 / (60 + v.r), 0) + coalesce(0.45 / (60 + l.r), 0), 10) AS score
FROM (SELECT * FROM v WHERE r <= 80) v FULL OUTER JOIN (SELECT * FROM l WHERE r <= 80) l ON v.id = l.id ORDER BY score DESC, doc_id LIMIT 20""")
def hybrid_search(spark, sf):
    lexical = retrieval.ranked(retrieval.bm25(load(spark, sf, "documents"), TERMS), "doc_id", 80)
    vector = retrieval.nearest_vectors(_probe(spark, sf), F.col("q"), 80).withColumnRenamed("vec_id", "doc_id")
    fused = retrieval.fuse_two(vector, lexical, "doc_id", 0.55, 0.45)
    return fused.select("doc_id", "vector_rank", "lexical_rank", F.round("score", 10).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents), b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS r FROM documents), c AS (SELECT doc_id, row_number() OVER (ORDER BY length(source), doc_id) AS r FROM documents),
u AS (SELECT doc_id, 1.0 / (60 + r) AS p FROM a WHERE r <= 30 UNION ALL SELECT doc_id, 0.5 / (60 + r) FROM b WHERE r <= 30 UNION ALL SELECT doc_id, 0.25 / (60 + r) FROM c WHERE r <= 30) SELECT doc_id, round(sum(p), 10) AS score FROM u GROUP BY doc_id""")
def rank_fusion(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "n_chars", "source")
    lists = [
        (retrieval.ranked(d.select("doc_id", F.col("n_chars").alias("score")), "doc_id", 30), 1.0),
        (retrieval.ranked(d.select("doc_id", F.col("doc_id").alias("score")), "doc_id", 30), 0.5),
        (retrieval.ranked(d.select("doc_id", (-F.length("source")).alias("score")), "doc_id", 30), 0.25),
    ]
    return retrieval.fuse(lists, "doc_id").select("doc_id", F.round("score", 10).alias("score"))


@query(f"""WITH tok AS (SELECT doc_id, source, {_TOKENS} AS t FROM documents WHERE source IN ('src1', 'src2', 'src3')), w AS (SELECT unnest(['thation', 'eron', 'erth', 'thnt']) AS term),
m AS (SELECT doc_id, term FROM tok, w WHERE list_contains(t, term)), n AS (SELECT count(*) AS n FROM tok), df AS (SELECT term, count(*) AS df FROM m GROUP BY term HAVING count(*) > 0),
s AS (SELECT doc_id, sum(ln((n + 1.0) / (df + 0.5))) AS rank_sum FROM m JOIN df USING (term), n GROUP BY doc_id), r AS (SELECT doc_id, rank_sum, row_number() OVER (ORDER BY rank_sum DESC NULLS LAST, doc_id) AS lr FROM s),
{_VEC}, v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY similarity DESC, vec_id) AS vr FROM vec JOIN tok ON vec_id = doc_id)
SELECT coalesce(r.doc_id, v.doc_id) AS doc_id, round(coalesce(0.4 / (60 + vr), 0) + coalesce(0.6 / (60 + lr), 0), 10) AS score FROM v FULL OUTER JOIN r ON v.doc_id = r.doc_id""")
def scoped_passages(spark, sf):
    d = load(spark, sf, "documents").where("source IN ('src1', 'src2', 'src3')").select("doc_id", tx.search_tokens(F.col("text")).alias("t"))
    terms = sorted(set(TERMS))
    has = d.select("doc_id", *[F.array_contains("t", w).cast("int").alias(f"h{i}") for i, w in enumerate(terms)])
    stats = has.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"h{i}").alias(f"df{i}") for i in range(len(terms))])
    total = sum((F.when(F.col(f"h{i}") > 0, F.log((F.col("n") + 1.0) / (F.col(f"df{i}") + 0.5))).otherwise(0.0) for i in range(len(terms))), F.lit(0.0))
    lexical = has.crossJoin(F.broadcast(stats)).select("doc_id", total.alias("score")).where("score > 0")
    lexical = lexical.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "doc_id")).cast("long"))  # scoped to the chosen papers
    scope = _probe(spark, sf).join(d.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    vector = scope.select(F.col("vec_id").alias("doc_id"), tx.cosine(F.col("embedding"), F.col("q")).alias("score"))
    vector = vector.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).cast("long"))
    return retrieval.fuse_two(vector, lexical, "doc_id", 0.4, 0.6).select("doc_id", F.round("score", 10).alias("score"))


@query("""WITH t AS (SELECT unnest(['eron', 'erth', 'tion']) AS term), m AS (SELECT doc_id, source, term, (length(text) - length(replace(text, term, ''))) // length(term) AS occ FROM documents, t WHERE strpos(text, term) > 0),
c AS (SELECT doc_id, source, sum(occ)::BIGINT AS occ, count(*) AS terms FROM m GROUP BY ALL)
SELECT source, max(terms) AS terms, count(*) AS passages, arg_min(doc_id, (-terms, -occ, doc_id)) AS best FROM c GROUP BY source""")
def papers_naming(spark, sf):
    terms = F.explode(F.array(*[F.lit(t) for t in ("eron", "erth", "tion")])).alias("term")
    m = load(spark, sf, "documents").select("doc_id", "source", "text", terms).where(F.expr("instr(text, term) > 0"))
    occ = F.expr("(length(text) - length(replace(text, term, ''))) div length(term)")
    c = m.select("doc_id", "source", occ.alias("occ")).groupBy("doc_id", "source").agg(F.sum("occ").alias("occ"), F.count(F.lit(1)).alias("terms"))
    return c.groupBy("source").agg(F.max("terms").alias("terms"), F.count(F.lit(1)).alias("passages"), F.min_by("doc_id", F.struct(-F.col("terms"), -F.col("occ"), "doc_id")).alias("best"))


@query("""WITH l AS (SELECT l_suppkey, l_partkey, CASE l_returnflag WHEN 'A' THEN 'USES' WHEN 'N' THEN 'MENTIONS' ELSE 'CITES' END AS pred, l_quantity, l_discount FROM lineitem),
s AS (SELECT l_suppkey, pred, count(*) AS n, sum(CASE WHEN l_discount > 0.08 THEN 100 WHEN l_discount > 0.05 THEN 10 ELSE 5 END)::BIGINT AS strength FROM l GROUP BY ALL)
SELECT l_suppkey, pred, n, strength, row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE pred WHEN 'USES' THEN 1 WHEN 'CITES' THEN 2 ELSE 3 END, strength DESC) AS place FROM s""")
def links_ranked(spark, sf):
    pred = F.when(F.col("l_returnflag") == "A", "USES").when(F.col("l_returnflag") == "N", "MENTIONS").otherwise("CITES")
    weight = F.when(F.col("l_discount") > 0.08, 100).when(F.col("l_discount") > 0.05, 10).otherwise(5)
    s = load(spark, sf, "lineitem").groupBy("l_suppkey", pred.alias("pred")).agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("strength"))
    order = F.when(F.col("pred") == "USES", 1).when(F.col("pred") == "CITES", 2).otherwise(3)
    return s.withColumn("place", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(order, F.desc("strength"))).cast("long"))


@query(r"""SELECT doc_id, strpos(lower(left(text, 60)), 'eron') AS position FROM documents WHERE regexp_matches(left(text, 60), '(?i)(^|[^A-Za-z0-9])eron([^A-Za-z0-9]|$)')""")
def papers_by_author(spark, sf):
    head = F.substring("text", 1, 60)
    return load(spark, sf, "documents").where(head.rlike("(?i)(^|[^A-Za-z0-9])eron([^A-Za-z0-9]|$)")).select("doc_id", F.instr(F.lower(head), "eron").cast("long").alias("position"))


@query("""WITH d AS (SELECT doc_id, source, n_chars, text FROM documents WHERE lang = 'en'), s AS (SELECT doc_id, source, n_chars, (CASE WHEN strpos(lower(left(text, 80)), 'eron') > 0 THEN 12 ELSE 0 END + CASE WHEN strpos(lower(text), 'eron') > 0 THEN 2 ELSE 0 END
+ CASE WHEN strpos(lower(left(text, 80)), 'erth') > 0 THEN 12 ELSE 0 END + CASE WHEN strpos(lower(text), 'erth') > 0 THEN 2 ELSE 0 END + CASE WHEN source = 'src3' THEN 10 ELSE 0 END)::BIGINT AS score FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS k FROM s) SELECT doc_id, source, score FROM r WHERE k <= 2 AND score > 0 ORDER BY score DESC, doc_id LIMIT 12""")
def lexical_rerank(spark, sf):
    head, body = F.lower(F.substring("text", 1, 80)), F.lower("text")
    score = F.lit(0)
    for w in ("eron", "erth"):
        score = score + F.when(F.instr(head, w) > 0, 12).otherwise(0) + F.when(F.instr(body, w) > 0, 2).otherwise(0)
    score = score + F.when(F.col("source") == "src3", 10).otherwise(0)
    s = load(spark, sf, "documents").where("lang = 'en'").select("doc_id", "source", score.cast("long").alias("score"))
    top = joins.top_per_group(s, ["source"], [F.desc("score"), "doc_id"], 2, "k").where("score > 0")
    return top.select("doc_id", "source", "score").orderBy(F.desc("score"), "doc_id").limit(12)


_RUNS = "list_distinct(list_transform(generate_series(1, len(w) - {k}), lambda i: array_to_string(w[i:i + {k}], ' ')))"


@query(f"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), g AS (SELECT doc_id, unnest({_RUNS.format(k=7)}) AS run FROM d WHERE len(w) >= 8),
f AS (SELECT run, min(doc_id) AS first FROM g GROUP BY run) SELECT doc_id, count(*) AS runs, count(*) FILTER (WHERE first < doc_id) AS known, count(*) FILTER (WHERE first < doc_id) > 0.2 * count(*) AS suppressed FROM g JOIN f USING (run) GROUP BY doc_id""")
def passage_suppression(spark, sf):
    docs = load(spark, sf, "documents")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sets = tx.shingle_sets(docs.select("doc_id", tx.plain_words(F.col("text")).alias("w")), ["doc_id"], "w", 8, "h")
    return runs.shared_runs(sets, size).withColumn("suppressed", F.col("known") > 0.2 * F.col("runs"))


@query(f"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), g AS (SELECT doc_id, unnest({_RUNS.format(k=11)}) AS run FROM d WHERE len(w) >= 12),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark), bg AS (SELECT item_id, unnest({_RUNS.format(k=11)}) AS run FROM b WHERE len(w) >= 12)
SELECT doc_id, count(DISTINCT item_id) AS items, count(DISTINCT run) AS runs FROM g JOIN bg USING (run) GROUP BY doc_id""")
def copy_detection(spark, sf):
    words = lambda df, id_: df.select(id_, tx.plain_words(F.col("text")).alias("w"))
    docs, items = load(spark, sf, "documents"), load(spark, sf, "benchmark")
    hashes = lambda df, id_: tx.shingle_hashes(words(df, id_), [id_], "w", 12, "h")
    known = materialize(hashes(items, "item_id").select("h").distinct(), "item-runs")
    known = F.broadcast(known) if known.count() <= retrieval.BROADCAST_ROWS else known
    # Hashes name the few documents that may hold a run; those are then compared word for word.
    maybe = materialize(hashes(docs, "doc_id").join(known, "h", "left_semi").select("doc_id").distinct(), "maybe")
    runs = lambda df, id_: tx.shingle_rows(words(df, id_), [id_], "w", 12, "run")
    hit = runs(docs.join(maybe, "doc_id", "left_semi"), "doc_id").join(runs(items, "item_id"), "run")
    return hit.groupBy("doc_id").agg(F.countDistinct("item_id").alias("items"), F.countDistinct("run").alias("runs"))


@query("SELECT p_partkey, (CASE WHEN starts_with(p_name, 'red') THEN 2.0 WHEN contains(p_name, 'red') THEN 1.0 ELSE 0 END + CASE WHEN p_type = 'ECONOMY' THEN 0.5 ELSE 0 END - CASE WHEN p_size < 10 THEN 0.25 ELSE 0 END)::DOUBLE AS score FROM part WHERE contains(p_name, 'red')")
def catalog_search(spark, sf):
    name = F.col("p_name")
    score = F.when(name.startswith("red"), 2.0).when(name.contains("red"), 1.0).otherwise(0.0) + F.when(F.col("p_type") == "ECONOMY", 0.5).otherwise(0.0) - F.when(F.col("p_size") < 10, 0.25).otherwise(0.0)
    return load(spark, sf, "part").where(name.contains("red")).select("p_partkey", score.alias("score"))


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM documents ORDER BY n_chars DESC, doc_id LIMIT 40), f AS (SELECT source, min(place) AS first FROM r GROUP BY source)
SELECT doc_id, place, dense_rank() OVER (ORDER BY first) AS citation FROM r JOIN f USING (source)""")
def numbered_citations(spark, sf):
    w = Window.orderBy(F.desc("n_chars"), "doc_id")
    r = load(spark, sf, "documents").select("doc_id", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(40).withColumn("place", F.row_number().over(w).cast("long"))
    f = r.withColumn("first", F.min("place").over(Window.partitionBy("source")))
    return f.select("doc_id", "place", F.dense_rank().over(Window.orderBy("first")).cast("long").alias("citation"))


@query("""WITH a AS (SELECT 'see [12], [4] and [999999], again [4]' AS answer), c AS (SELECT DISTINCT unnest(regexp_extract_all(answer, '\\[([0-9]+)\\]', 1))::BIGINT AS id FROM a) SELECT doc_id FROM documents WHERE doc_id IN (SELECT id FROM c)""".replace("\\\\", "\\"))
def citation_selection(spark, sf):
    a = spark.createDataFrame([("see [12], [4] and [999999], again [4]",)], "answer string")
    c = a.select(F.explode(F.regexp_extract_all("answer", F.lit(r"\[([0-9]+)\]"), 1)).alias("id")).select(F.col("id").cast("long").alias("doc_id")).distinct()
    return load(spark, sf, "documents").select("doc_id").join(F.broadcast(c), "doc_id", "left_semi")


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY (n_chars > 500) DESC, n_chars, doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT doc_id, CASE WHEN n >= 2 AND k > 1 THEN 'fulltext' ELSE 'primary' END AS layer FROM r""")
def layer_assignment(spark, sf):
    w = Window.partitionBy("source")
    k = F.row_number().over(w.orderBy((F.col("n_chars") > 500).desc(), "n_chars", "doc_id"))
    return load(spark, sf, "documents").select("doc_id", F.when((F.count(F.lit(1)).over(w) >= 2) & (k > 1), "fulltext").otherwise("primary").alias("layer"))


@query("""SELECT conv_id, turn, regexp_matches(lower(text), 'figure|image|color') AS visual, regexp_matches(lower(text), 'tion|ment') AS scientific, regexp_matches(text, '[A-Z]{2}[0-9]{2}') AS identifier FROM conversations""")
def question_routing(spark, sf):
    t = F.lower("text")
    return load(spark, sf, "conversations").select("conv_id", "turn", t.rlike("figure|image|color").alias("visual"), t.rlike("tion|ment").alias("scientific"), F.col("text").rlike("[A-Z]{2}[0-9]{2}").alias("identifier"))


# --- graph -------------------------------------------------------------------------------------------------------

_EDGES = "e AS (SELECT DISTINCT 'S' || l_suppkey AS src, l_returnflag AS pred, 'P' || l_partkey AS dst FROM lineitem)"


def _edges(spark, sf) -> DataFrame:
    l = load(spark, sf, "lineitem")
    return l.select(F.concat(F.lit("S"), "l_suppkey").alias("src"), F.col("l_returnflag").alias("pred"), F.concat(F.lit("P"), "l_partkey").alias("dst")).distinct()


def _level(n: int, frontier: str, before: str) -> str:
    return f"""x{n} AS (SELECT *, row_number() OVER (PARTITION BY node, direction ORDER BY next, pred) AS k FROM b WHERE node IN (SELECT node FROM {frontier})),
l{n} AS (SELECT next AS node, {n} AS depth, (min((direction, pred)))[1] AS direction, (min((direction, pred)))[2] AS pred FROM x{n} WHERE k <= 25 AND next NOT IN ({before}) GROUP BY next)"""


_WALK = f"""WITH {_EDGES}, b AS (SELECT src AS node, dst AS next, 'out' AS direction, pred FROM e UNION ALL SELECT dst, src, 'in', pred FROM e), l0 AS (SELECT 'S3' AS node, 0 AS depth, 'self' AS direction, 'SELF' AS pred),
{_level(1, 'l0', 'SELECT node FROM l0')}, {_level(2, 'l1', 'SELECT node FROM l0 UNION SELECT node FROM l1')}
SELECT node, depth, direction, pred FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2) ORDER BY depth, node LIMIT 250"""


@query(_WALK)
def graph_neighbours(spark, sf):
    return graph.neighbours(_edges(spark, sf), spark.createDataFrame([("S3",)], "node string"), 2)


@query(f"""WITH {_EDGES}, b AS (SELECT src AS node, dst AS next FROM e WHERE pred IN ('A', 'R') UNION ALL SELECT dst, src FROM e WHERE pred IN ('A', 'R')), one AS (SELECT b.next AS node, ['S3', b.next] AS path FROM b WHERE node = 'S3'), two AS (SELECT b.next AS node, list_append(path, b.next) AS path FROM one JOIN b USING (node) WHERE NOT list_contains(path, b.next))
SELECT depth, count(*) AS paths, count(DISTINCT node) AS nodes FROM (SELECT 1 AS depth, node FROM one UNION ALL SELECT 2, node FROM two) GROUP BY depth""")
def graph_simple_paths(spark, sf):
    p = graph.simple_paths(_edges(spark, sf), spark.createDataFrame([("S3",)], "node string"), 2, ["A", "R"])
    return p.groupBy("depth").agg(F.count(F.lit(1)).alias("paths"), F.countDistinct("node").alias("nodes"))


_TREE = "h AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 0 THEN (p_partkey - 1) // 12 END AS parent FROM part)"


def _tree(spark, sf) -> DataFrame:
    return load(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") > 0, F.floor((F.col("p_partkey") - 1) / 12)).alias("parent"))


@query(f"""WITH RECURSIVE {_TREE}, c(ancestor, node, distance) AS (SELECT node, node, 0 FROM h UNION ALL SELECT h.parent, c.node, distance + 1 FROM c JOIN h ON h.node = c.ancestor WHERE h.parent IS NOT NULL AND distance < 4)
SELECT ancestor, count(*) AS members, max(distance)::BIGINT AS deepest FROM c GROUP BY ancestor""")
def hierarchy_closure(spark, sf):
    return graph.closure(_tree(spark, sf)).groupBy("ancestor").agg(F.count(F.lit(1)).alias("members"), F.max("distance").cast("long").alias("deepest"))


@query(f"""WITH {_TREE} SELECT node FROM h WHERE node NOT IN (SELECT parent FROM h WHERE parent IS NOT NULL)""")
def most_specific(spark, sf):
    m = _tree(spark, sf)
    return m.join(m.select(F.col("parent").alias("p")), F.col("node") == F.col("p"), "left_anti").select("node")


@query("SELECT count(*) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS dangling_customers, count(*) FILTER (WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS empty_orders FROM orders")
def endpoint_resolution(spark, sf):
    o = load(spark, sf, "orders")
    a = o.join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg(F.count(F.lit(1)).alias("dangling_customers"))
    b = o.join(load(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").agg(F.count(F.lit(1)).alias("empty_orders"))
    return a.crossJoin(b)


# --- evaluation --------------------------------------------------------------------------------------------------

_JUDGED = """r AS (SELECT source, d.doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, d.doc_id) AS rank FROM documents d), g AS (SELECT doc_id, max(quality + toxic) AS gain FROM labels GROUP BY doc_id),
j AS (SELECT r.*, coalesce(g.gain, 0) AS gain FROM r LEFT JOIN g USING (doc_id))"""


def _judged(spark, sf) -> DataFrame:
    r = load(spark, sf, "documents").select("source", "doc_id", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    g = load(spark, sf, "labels").groupBy("doc_id").agg(F.max(F.col("quality") + F.col("toxic")).alias("gain"))
    return r.join(g, "doc_id", "left").select("source", "doc_id", "rank", F.coalesce("gain", F.lit(0)).alias("gain"))


@query(f"WITH {_JUDGED} SELECT source, CASE WHEN count(*) FILTER (WHERE gain > 0) = 0 THEN 1.0 ELSE round(count(*) FILTER (WHERE gain > 0 AND rank <= 10) / count(*) FILTER (WHERE gain > 0), 8) END AS recall, round(coalesce(1.0 / min(rank) FILTER (WHERE gain > 0), 0), 8) AS mrr FROM j GROUP BY source")
def recall_and_mrr(spark, sf):
    relevant = F.count_if(F.col("gain") > 0)
    return _judged(spark, sf).groupBy("source").agg(
        F.when(relevant == 0, 1.0).otherwise(F.round(F.count_if((F.col("gain") > 0) & (F.col("rank") <= 10)) / relevant, 8)).alias("recall"),
        F.round(F.coalesce(1.0 / F.min(F.when(F.col("gain") > 0, F.col("rank"))), F.lit(0.0)), 8).alias("mrr"),
    )


@query(f"""WITH {_JUDGED}, i AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY gain DESC, rank) AS ideal FROM j), s AS (SELECT source, coalesce(sum((pow(2, gain) - 1) / log2(rank + 1)) FILTER (WHERE rank <= 10), 0) AS dcg, coalesce(sum((pow(2, gain) - 1) / log2(ideal + 1)) FILTER (WHERE ideal <= 10), 0) AS best FROM i GROUP BY source)
SELECT source, CASE WHEN best = 0 THEN 1.0 ELSE round(dcg / best, 8) END AS ndcg FROM s""")
def ndcg(spark, sf):
    i = _judged(spark, sf).withColumn("ideal", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("gain"), "rank")))
    dcg = lambda place: F.coalesce(F.sum(F.when(F.col(place) <= 10, (F.pow(F.lit(2.0), F.col("gain")) - 1) / F.log2(F.col(place) + F.lit(1.0)))), F.lit(0.0))
    s = i.groupBy("source").agg(dcg("rank").alias("dcg"), dcg("ideal").alias("best"))
    return s.select("source", F.when(F.col("best") == 0, 1.0).otherwise(F.round(F.col("dcg") / F.col("best"), 8)).alias("ndcg"))


@query("""WITH g AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), f AS (SELECT doc_id FROM documents WHERE n_chars > 800), judged AS (SELECT DISTINCT doc_id FROM labels)
SELECT (SELECT count(*) FROM f JOIN g USING (doc_id)) AS hit, (SELECT count(*) FROM g) AS wanted, (SELECT count(*) FROM f JOIN judged USING (doc_id)) AS judged_found""")
def link_precision_recall(spark, sf):
    g = load(spark, sf, "labels").where("quality = 1").select("doc_id").distinct()
    judged = load(spark, sf, "labels").select("doc_id").distinct()
    f = load(spark, sf, "documents").where("n_chars > 800").select("doc_id")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(f.join(g, "doc_id"), "hit").crossJoin(n(g, "wanted")).crossJoin(n(f.join(judged, "doc_id"), "judged_found"))


@query("""WITH h AS (SELECT source, doc_id, sha256('7|' || doc_id)[1:12] AS h FROM documents) SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY h, doc_id) % 2 = 1 THEN 'train' ELSE 'blind' END AS split FROM h""")
def stratified_split(spark, sf):
    h = load(spark, sf, "documents").select("source", "doc_id", F.substring(F.sha2(F.concat(F.lit("7|"), F.col("doc_id").cast("string")), 256), 1, 12).alias("h"))
    k = F.row_number().over(Window.partitionBy("source").orderBy("h", "doc_id"))
    return h.select("doc_id", F.when(k % 2 == 1, "train").otherwise("blind").alias("split"))


@query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50), b AS (SELECT doc_id, row_number() OVER (ORDER BY length(text) + length(source) * 50 DESC, doc_id) AS r FROM documents ORDER BY length(text) + length(source) * 50 DESC, doc_id LIMIT 50)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.r IS NULL THEN 'lost' WHEN a.r IS NULL THEN 'gained' WHEN a.r = b.r THEN 'same' ELSE 'moved' END AS change FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id""")
def evidence_comparison(spark, sf):
    d = load(spark, sf, "documents")
    a = retrieval.ranked(d.select("doc_id", F.col("n_chars").alias("score")), "doc_id", 50).select("doc_id", F.col("rank").alias("a"))
    b = retrieval.ranked(d.select("doc_id", (F.length("text") + F.length("source") * 50).alias("score")), "doc_id", 50).select("doc_id", F.col("rank").alias("b"))
    return a.join(b, "doc_id", "full_outer").select("doc_id", F.when(F.col("b").isNull(), "lost").when(F.col("a").isNull(), "gained").when(F.col("a") == F.col("b"), "same").otherwise("moved").alias("change"))


@query(r"""SELECT conv_id, count(*) FILTER (WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9])tion[a-z]*')) AS fact_hits, count(*) FILTER (WHERE regexp_matches(text, '(^|[^0-9])(19|20)[0-9]{2}($|[^0-9])')) AS year_hits FROM conversations GROUP BY conv_id""")
def fact_scoring(spark, sf):
    return load(spark, sf, "conversations").groupBy("conv_id").agg(F.count_if(F.col("text").rlike("(?i)(^|[^A-Za-z0-9])tion[a-z]*")).alias("fact_hits"), F.count_if(F.col("text").rlike("(^|[^0-9])(19|20)[0-9]{2}($|[^0-9])")).alias("year_hits"))
