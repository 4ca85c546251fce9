"""Facts in answers, keys of citations, nearest places, tools by stems."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import facts, stemming
from ..operators import citations, fulltext, joins
from ..sources.tables import load
from .registry import query
from .searching import _CUT

_ANSWER = """CASE o_orderkey % 8 WHEN 0 THEN concat('Deployed ', date_format(o_orderdate, 'yyyy-MM-dd'), ' at ', format_number(o_totalprice, 1), ' m by A-', o_custkey) WHEN 1 THEN concat('on ', date_format(o_orderdate, 'MMMM'), ' ', day(o_orderdate), ', ', year(o_orderdate), ' near ', round(o_totalprice * 1.01, 2), ', unit a-', o_custkey, '.')
WHEN 2 THEN concat(day(o_orderdate), ' ', date_format(o_orderdate, 'MMM'), '. ', year(o_orderdate), ' ', round(o_totalprice * 1.05, 2), ' XA-', o_custkey) WHEN 3 THEN concat('since ', date_format(o_orderdate, 'yyyy/MM/dd'), ' A-', o_custkey, '-B') WHEN 4 THEN concat(day(o_orderdate) + 40, ' ', date_format(o_orderdate, 'MMM'), ' ', year(o_orderdate)) ELSE 'no idea' END"""


@query("""SELECT o_orderkey, o_orderkey % 8 <= 3 AS date_ok, o_orderkey % 8 <= 1 OR (o_orderkey % 8 >= 2 AND o_totalprice < 0) AS number_ok, o_orderkey % 8 <= 1 AS unit_ok FROM orders WHERE o_totalprice > 60000""")
def facts_stated(spark, sf):
    o = load(spark, sf, "orders").where("o_totalprice > 60000").withColumn("said", F.expr(_ANSWER))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select("o_orderkey", facts.states_date(F.col("said"), day).alias("date_ok"), facts.states_number(F.col("said"), F.col("o_totalprice"), 0.02 * F.col("o_totalprice")).alias("number_ok"), facts.states_word(F.col("said"), F.concat(F.lit("A-"), "o_custkey")).alias("unit_ok"))


@query(r"""SELECT p_partkey, lower(rtrim('10.5/Ab' || p_partkey, '.')) AS doi, regexp_replace(lower(strip_accents('Été à ' || p_name || ': n° ' || p_size)), '[^a-z0-9]', '', 'g') AS title FROM part""")
def citation_keys(spark, sf):
    doi = F.concat(F.when(F.col("p_size") > 25, " https://DOI.org/10.5/Ab").otherwise("http://dx.doi.org/10.5/Ab"), "p_partkey", F.lit(".; "))
    title = F.concat(F.lit("Été à "), "p_name", F.lit(": n° "), "p_size")
    return load(spark, sf, "part").select("p_partkey", citations.plain_doi(doi).alias("doi"), citations.plain(title).alias("title"))


_KM = "2 * 6371.0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))"


@query(f"""WITH a AS (SELECT c_custkey AS lid, c_custkey * 37 % 1200 / 10.0 - 60 AS lat, c_custkey * 91 % 3600 / 10.0 - 180 AS lon FROM customer), b AS (SELECT s_suppkey AS rid, s_suppkey * 53 % 1200 / 10.0 - 60 AS lat, s_suppkey * 71 % 3600 / 10.0 - 180 AS lon FROM supplier)
SELECT lid, arg_min(rid, (km, rid)) AS rid, round(min(km), 4) AS km FROM (SELECT lid, rid, {_KM} AS km FROM a JOIN b ON abs(a.lat - b.lat) < 15) WHERE km <= 1500 GROUP BY lid""")
def nearest_place(spark, sf):
    place = lambda k, name, f, g: [F.col(k).alias(name), (F.col(k) * f % 1200 / 10.0 - 60).alias("lat"), (F.col(k) * g % 3600 / 10.0 - 180).alias("lon")]
    found = joins.nearest_within(load(spark, sf, "customer").select(*place("c_custkey", "lid", 37, 91)), load(spark, sf, "supplier").select(*place("s_suppkey", "rid", 53, 71)), 1500.0)
    return found.select("lid", "rid", F.round("km", 4).alias("km"))


@query(f"""WITH f AS (SELECT p_partkey, {_CUT.format("p_name")} AS a, {_CUT.format("concat(p_brand, ' ', p_type)")} AS b FROM part), tok AS (SELECT p_partkey, unnest(a) AS word, generate_subscripts(a, 1) AS pos, 1.0 AS weight FROM f UNION ALL SELECT p_partkey, unnest(b), len(a) + generate_subscripts(b, 1), 0.4 FROM f),
words AS (SELECT DISTINCT word FROM tok), {stemming.stem_sql("words", "stems")}, h AS (SELECT p_partkey, stem, pos, 1 / weight AS cost FROM tok JOIN stems USING (word) WHERE stem IN ('larg', 'widget')),
n AS (SELECT *, row_number() OVER w AS i, sum(cost) OVER w AS costs, max(CASE WHEN stem = 'larg' THEN pos END) OVER w AS l, max(CASE WHEN stem = 'widget' THEN pos END) OVER w AS g FROM h WINDOW w AS (PARTITION BY p_partkey ORDER BY pos)),
c AS (SELECT *, least(l, g) AS start FROM n WHERE l IS NOT NULL AND g IS NOT NULL), k AS (SELECT *, lag(start) OVER (PARTITION BY p_partkey ORDER BY pos) AS before FROM c)
SELECT k.p_partkey, round(sum((k.i - b.i + 1) / (k.costs - b.costs + b.cost) / (1 + k.pos - b.pos - (k.i - b.i))), 9) AS rank FROM k JOIN n b ON b.p_partkey = k.p_partkey AND b.pos = k.start WHERE before IS NULL OR k.start > before GROUP BY k.p_partkey ORDER BY rank DESC, k.p_partkey LIMIT 20""")
def tools_by_stems(spark, sf):
    index = fulltext.build(load(spark, sf, "part"), "p_partkey", [(F.col("p_name"), "A"), (F.concat_ws(" ", "p_brand", "p_type"), "B")], "tools")
    found = fulltext.best(fulltext.search(index, "larger widgets or large widgets"), "p_partkey", "rank", 20)
    return found.select("p_partkey", F.round("score", 9).alias("rank"))
