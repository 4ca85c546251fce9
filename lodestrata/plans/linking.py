"""Links, sites, seeds, questions and choices among candidates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import questions as qs
from ..operators import joins, linking, retrieval
from ..sources.tables import epoch_seconds, load
from .registry import query
from .retrieval import _EDGES, _edges

_HITS = """l_partkey AS paper, l_suppkey % 7 AS sensor, l_orderkey * 10 + l_linenumber AS hit, CASE WHEN l_suppkey % 7 < 2 AND l_orderkey % 3 = 0 THEN 'named' WHEN l_suppkey % 7 = 1 THEN 'range' WHEN l_suppkey % 7 = 2 THEN 'system' ELSE 'described' END AS kind,
CASE WHEN l_returnflag = 'A' OR l_partkey % 5 = 0 THEN 'abstract' ELSE 'fulltext' END AS layer, l_discount > 0.07 AS use, l_suppkey % 7 - 3 AS share, CAST(l_quantity AS BIGINT) % 5 AS stations"""
_PAPERS = "p_partkey AS paper, 2010 + p_partkey % 14 AS year, p_type = 'PROMO' AS overview, p_size > 25 AS on_topic"


@query(f"""WITH h AS (SELECT {_HITS} FROM lineitem), p AS (SELECT {_PAPERS} FROM part), a AS (SELECT paper, sensor, count(*) AS n, count(*) FILTER (WHERE use) AS n_use, bool_or(kind IN ('named', 'range', 'designator')) AS coded, bool_or(kind = 'system') AS system,
bool_or(layer = 'fulltext') AS fulltext, bool_or(use AND layer = 'abstract') AS abstract_use, min(CASE WHEN share > 0 THEN share ELSE 1 END) AS share, bool_or(stations >= 3) AS tabled,
arg_min(hit, (NOT use, kind NOT IN ('named', 'range', 'designator'), kind <> 'system', layer <> 'fulltext', hit)) AS best FROM h GROUP BY paper, sensor),
r AS (SELECT paper, sensor, n, n_use, best, CASE WHEN year < 2013 THEN CASE WHEN coded OR system THEN 'mentioned' END WHEN overview THEN CASE WHEN coded OR system OR share <= 2 THEN 'mentioned' END
WHEN NOT fulltext THEN CASE WHEN coded OR system OR (share <= 2 AND abstract_use) THEN 'used' END WHEN coded THEN CASE WHEN n >= 3 OR n_use >= 1 OR (tabled AND on_topic) THEN 'used' ELSE 'mentioned' END
WHEN system THEN CASE WHEN n_use >= 2 OR abstract_use THEN 'used' ELSE 'mentioned' END WHEN share <= 2 THEN CASE WHEN n_use >= 2 OR abstract_use THEN 'used' WHEN n_use > 0 THEN 'mentioned' END
WHEN (abstract_use AND n_use >= 3) OR n_use >= 6 THEN 'used' END AS relation FROM a JOIN p USING (paper)) SELECT paper, sensor, relation, n, n_use, best FROM r WHERE relation IS NOT NULL""")
def judged_links(spark, sf):
    return linking.judge_links(load(spark, sf, "lineitem").selectExpr(*_exprs(_HITS)), load(spark, sf, "part").selectExpr(*_exprs(_PAPERS)))


def _exprs(columns: str) -> list[str]:
    """The parts of a select list in which no expression holds a comma."""
    return columns.replace("\n", " ").split(", ")


@query("""WITH u AS (SELECT l_orderkey AS paper, CASE l_suppkey % 3 WHEN 0 THEN 'AX01' WHEN 1 THEN 'MG02' ELSE 'AX07' END || l_linenumber AS place FROM lineitem), n AS (SELECT DISTINCT l_orderkey AS paper, 'vents' AS site FROM lineitem WHERE l_quantity > 45),
g AS (SELECT paper FROM u GROUP BY paper HAVING count(DISTINCT place[1:4]) = 1), p(site, prefix) AS (VALUES ('vents', 'AX01'), ('caldera', 'AX07'), ('margin', 'MG')), own AS (SELECT paper, site, min(why) AS why FROM (SELECT paper, site, 'named' AS why FROM n UNION ALL
SELECT paper, site, 'sensors' FROM u JOIN g USING (paper) JOIN p ON starts_with(place, prefix)) GROUP BY paper, site), up(site, parent, level) AS (VALUES ('vents', 'caldera', 1), ('caldera', 'volcano', 2), ('margin', 'coast', 3))
SELECT paper, site, arg_min(why, level) AS why FROM (SELECT paper, site, why, 0 AS level FROM own UNION ALL SELECT paper, parent, why, level FROM own JOIN up USING (site)) GROUP BY paper, site""")
def study_sites(spark, sf):
    l = load(spark, sf, "lineitem")
    code = F.when(F.col("l_suppkey") % 3 == 0, "AX01").when(F.col("l_suppkey") % 3 == 1, "MG02").otherwise("AX07")
    used = l.select(F.col("l_orderkey").alias("paper"), F.concat(code, F.col("l_linenumber").cast("string")).alias("place"))
    named = l.where("l_quantity > 45").select(F.col("l_orderkey").alias("paper"), F.lit("vents").alias("site")).distinct()
    return linking.study_sites(used, named, [("vents", "AX01"), ("caldera", "AX07"), ("margin", "MG")], [("vents", "caldera"), ("caldera", "volcano"), ("margin", "coast")])


_VARIABLE = """CASE p_partkey % 9 WHEN 0 THEN 'time' WHEN 1 THEN 'sea_water_temperature' WHEN 2 THEN 'sea_water_pressure_qc_agg' WHEN 3 THEN 'depth_reading' WHEN 4 THEN 'Depth' WHEN 5 THEN 'sea_water_density' WHEN 6 THEN 'z' WHEN 7 THEN 'station' ELSE concat('oxygen_', p_size) END"""


@query(f"""WITH v AS (SELECT DISTINCT p_name AS dataset, {_VARIABLE} AS variable FROM part), m AS (SELECT *, regexp_matches(variable, '{linking.CO_LOCATED}') AS beside FROM v WHERE NOT regexp_matches(variable, '{linking.NOT_MEASURED}'))
SELECT dataset, variable FROM m WHERE NOT beside OR dataset NOT IN (SELECT dataset FROM m WHERE NOT beside)""")
def measured_variables(spark, sf):
    return linking.measured_variables(load(spark, sf, "part").selectExpr("p_name AS dataset", f"{_VARIABLE} AS variable").distinct())


@query("""WITH e AS (SELECT user_id, event_type, epoch_us(ts) / 1e6 AS t FROM events), n AS (SELECT max(t) AS now FROM e), g AS (SELECT user_id, max(t) FILTER (WHERE event_type = 'click') AS a, max(t) FILTER (WHERE event_type = 'purchase') AS b, max(t) FILTER (WHERE event_type = 'signup') AS c FROM e GROUP BY user_id)
SELECT user_id AS station, CASE WHEN now - a < 259200 THEN 'click' WHEN now - b <= 259200 THEN 'purchase' WHEN now - c <= 259200 THEN 'signup' ELSE 'click' END AS channel,
round(CASE WHEN now - a < 259200 THEN now - a WHEN now - b <= 259200 THEN now - b WHEN now - c <= 259200 THEN now - c ELSE now - a END, 3) AS lag FROM g, n""")
def fresh_channel(spark, sf):
    e = load(spark, sf, "events").select(F.col("user_id").alias("station"), F.col("event_type").alias("channel"), epoch_seconds("ts").alias("t"))
    now = e.agg(F.max("t").alias("now"))
    chosen = linking.fresh_or_lower(e.crossJoin(F.broadcast(now)), ["click", "purchase", "signup"], F.col("now"), 259200.0)  # one row
    return chosen.select("station", "channel", F.round("lag", 3).alias("lag"))


_ANSWER = "CASE conv_id % 3 WHEN 0 THEN concat('see [', conv_id % 4 + 1, '] and [', conv_id % 2 + 1, ']') WHEN 1 THEN 'see [99]' ELSE 'none' END"


@query(f"""WITH a AS (SELECT DISTINCT conv_id AS answer, {_ANSWER} AS text FROM conversations), e AS (SELECT conv_id AS answer, turn + 1 AS place FROM conversations),
h AS (SELECT answer, place, list_contains(list_transform(regexp_extract_all(text, '\\[([0-9]+)\\]', 1), lambda x: x::BIGINT), place) AS hit FROM e JOIN a USING (answer))
SELECT answer, place FROM (SELECT *, bool_or(hit) OVER (PARTITION BY answer) AS cites FROM h) WHERE hit OR (NOT cites AND place <= 3)""")
def citations_or_first(spark, sf):
    c = load(spark, sf, "conversations")
    return linking.cited_or_first(c.selectExpr("conv_id AS answer", "turn + 1 AS place"), c.selectExpr("conv_id AS answer", f"{_ANSWER} AS text").distinct())


def _level(n: int, frontier: str, before: str) -> str:
    return f"""x{n} AS (SELECT s.seed, b.*, row_number() OVER (PARTITION BY s.seed, b.node, b.direction ORDER BY b.next, b.pred) AS k FROM b JOIN {frontier} s ON s.node = b.node),
l{n} AS (SELECT seed, next AS node, {n} AS depth, (min((direction, pred)))[1] AS direction, (min((direction, pred)))[2] AS pred FROM x{n} WHERE k <= 25 AND (seed, next) NOT IN ({before}) GROUP BY seed, next)"""


@query(f"""WITH {_EDGES}, b AS (SELECT src AS node, dst AS next, 'out' AS direction, pred FROM e UNION ALL SELECT dst, src, 'in', pred FROM e), l0(seed, node) AS (VALUES (1, 'P7'), (2, 'S3'), (3, 'P2')),
{_level(1, 'l0', 'SELECT seed, node FROM l0')}, {_level(2, 'l1', 'SELECT seed, node FROM l0 UNION SELECT seed, node FROM l1')}
SELECT seed, node, depth, direction, pred FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) ORDER BY seed, depth, node LIMIT 199""")
def seeds_shared_budget(spark, sf):
    seeds = spark.createDataFrame([(1, "P7"), (2, "S3"), (3, "P2")], "seed int, node string")
    return linking.expand_seeds(_edges(spark, sf), seeds, 2, limit=200)


_M = "split_part('jan,february,mar,april,may,june,july,aug,sept,october,nov,dec', ',', CAST(o_custkey % 12 + 1 AS INT))"
_ASKED = f"""CASE o_orderkey % 9 WHEN 0 THEN concat('Quakes on ', 2010 + o_custkey % 16, '-', o_custkey % 13 + 1, '-', o_orderkey % 31 + 1, ' above magnitude ', o_custkey % 4)
WHEN 1 THEN concat('Mag 2.', o_custkey % 10, ' or larger on ', {_M}, ' ', o_orderkey % 31 + 1, 'th, 20', 10 + o_custkey % 16) WHEN 2 THEN concat('on ', o_orderkey % 31 + 1, ' of ', {_M}, ' how many over 3?') WHEN 3 THEN concat('the ', o_orderkey % 31 + 1, 'rd ', {_M}, ' 2015, at least M ', o_custkey % 5)
WHEN 4 THEN concat(o_custkey % 13, '/', o_orderkey % 33, '/2012 with >= ', o_custkey % 3) WHEN 5 THEN concat('M2+ on ', o_custkey % 12 + 1, '/', o_orderkey % 30 + 1) WHEN 6 THEN concat('2019 ', {_M}, ' ', o_orderkey % 31 + 1) WHEN 7 THEN concat('since ', {_M}, ' exceeding a mw -0.', o_custkey % 9) ELSE 'nothing dated' END"""


# The SQL takes day and magnitude from the numbers that the question is made of.
_MONTH_NO = "(o_custkey % 12 + 1)"
_ASKED_DAY = f"""CASE o_orderkey % 9 WHEN 0 THEN [2010 + o_custkey % 16, o_custkey % 13 + 1, o_orderkey % 31 + 1] WHEN 1 THEN [2010 + o_custkey % 16, {_MONTH_NO}, o_orderkey % 31 + 1] WHEN 2 THEN [NULL, {_MONTH_NO}, o_orderkey % 31 + 1]
WHEN 3 THEN [2015, {_MONTH_NO}, o_orderkey % 31 + 1] WHEN 4 THEN [2012, o_custkey % 13, o_orderkey % 33] WHEN 5 THEN [NULL, {_MONTH_NO}, o_orderkey % 30 + 1] WHEN 6 THEN [2019, {_MONTH_NO}, o_orderkey % 31 + 1] END"""
_ASKED_FLOOR = "CASE o_orderkey % 9 WHEN 0 THEN o_custkey % 4 WHEN 1 THEN ('2.' || o_custkey % 10)::DOUBLE WHEN 3 THEN o_custkey % 5 WHEN 4 THEN o_custkey % 3 WHEN 5 THEN 2 WHEN 7 THEN -((o_custkey % 9) / 10.0) END::DOUBLE"


@query(f"""WITH a AS (SELECT o_orderkey, {_ASKED_DAY} AS p, {_ASKED_FLOOR} AS floor FROM orders), t AS (SELECT *, '-' || lpad(p[2]::VARCHAR, 2, '0') || '-' || lpad(p[3]::VARCHAR, 2, '0') AS tail FROM a),
f AS (SELECT *, CASE WHEN p[1] IS NOT NULL THEN p[1] || tail WHEN '2024' || tail > '2024-06-15' THEN '2023' || tail ELSE '2024' || tail END AS day FROM t)
SELECT o_orderkey, CASE WHEN TRY_CAST(day AS DATE) IS NOT NULL THEN day END AS day, floor, CASE WHEN floor IS NOT NULL THEN o_orderkey % 9 IN (1, 3, 4, 5) END AS inclusive FROM f""")
def question_days(spark, sf):
    q = load(spark, sf, "orders").select("o_orderkey", F.expr(_ASKED).alias("q")).withColumn("m", qs.magnitude_floor(F.col("q")))
    return q.select("o_orderkey", qs.named_day(F.col("q"), "2024-06-15").alias("day"), F.col("m.value").alias("floor"), F.col("m.inclusive").alias("inclusive"))


@query("""WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '[^\\s]+')[1:6] AS w FROM conversations) SELECT conv_id, turn, list_sort(list_distinct(list_filter(w, lambda x: regexp_full_match(x, '[A-Za-z0-9-]{3,40}')))) AS terms FROM t""")
def valid_terms(spark, sf):
    first = F.slice(F.regexp_extract_all("text", F.lit(r"([^\s]+)"), 1), 1, 6)
    return load(spark, sf, "conversations").select("conv_id", "turn", F.array_sort(F.array_distinct(F.filter(first, lambda x: x.rlike("^[A-Za-z0-9-]{3,40}$")))).alias("terms"))


@query("""WITH l AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, value / 10 AS lat FROM events WHERE event_type = 'click'), r AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, value / 10 AS lat FROM events WHERE event_type = 'error')
SELECT l.event_id AS left_id, arg_min(r.event_id, (abs(l.t - r.t), r.t, r.event_id)) AS right_id FROM l LEFT JOIN r ON l.user_id = r.user_id AND abs(l.t - r.t) <= 86400 AND abs(l.lat - r.lat) <= 5 GROUP BY l.event_id""")
def join_nearest_in_time_and_place(spark, sf):
    e = load(spark, sf, "events").select("event_id", "user_id", "event_type", epoch_seconds("ts").alias("t"), (F.col("value") / 10).alias("lat"))
    near = lambda a, b: F.abs(a["lat"] - b["lat"]) <= 5
    return joins.nearest_in_time(e.where("event_type = 'click'"), e.where("event_type = 'error'"), ["user_id"], "t", "event_id", "event_id", 86400.0, place=["lat"], near=near)


@query("""WITH t AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS d FROM part) SELECT p_partkey, d AS tool, (contains(d, 'small'))::INT + 2 * (contains(d, 'economy'))::INT AS score FROM t WHERE list_has_all(string_split(d, ' '), ['economy', 'widget']) ORDER BY score DESC, tool, p_partkey LIMIT 20""")
def tool_routing(spark, sf):
    tools = load(spark, sf, "part").select("p_partkey", F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("tool"))
    return retrieval.route(tools, "tool", ["economy", "widget"], {"small": 1, "economy": 2}, 50, ["tool", "p_partkey"])


@query("""WITH g AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), f AS (SELECT DISTINCT doc_id, source FROM documents WHERE n_chars > 800), j AS (SELECT DISTINCT doc_id FROM labels), d AS (SELECT DISTINCT doc_id, source FROM documents),
w AS (SELECT source, count(*) AS wanted, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM f)) AS hit FROM d JOIN g USING (doc_id) GROUP BY source), p AS (SELECT source, count(*) AS found FROM f JOIN j USING (doc_id) GROUP BY source)
SELECT source, CASE WHEN coalesce(wanted, 0) = 0 THEN 1.0 ELSE round(hit / wanted, 8) END AS recall, CASE WHEN coalesce(found, 0) = 0 THEN 1.0 ELSE round(coalesce(hit, 0) / found, 8) END AS judged_precision FROM (SELECT DISTINCT source FROM d) LEFT JOIN w USING (source) LEFT JOIN p USING (source)""")
def link_ratios(spark, sf):
    j = load(spark, sf, "labels").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("wanted"))
    d = load(spark, sf, "documents").groupBy("doc_id", "source").agg(F.max(F.col("n_chars") > 800).alias("found")).join(j, "doc_id", "left")
    wanted, found, both = F.count_if("wanted"), F.count_if(F.col("found") & F.col("wanted").isNotNull()), F.count_if(F.col("found") & F.col("wanted"))
    ratio = lambda a, b: F.when(b == 0, 1.0).otherwise(F.round(a / b, 8))
    return d.groupBy("source").agg(ratio(both, wanted).alias("recall"), ratio(both, found).alias("judged_precision"))
