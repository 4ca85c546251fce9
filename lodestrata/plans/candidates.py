"""Candidate links from the documents' own words and a line of codes under each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import candidates, linking
from ..sources.tables import load
from .registry import query

_TEXT = """concat(text, CASE doc_id % 4 WHEN 0 THEN concat(' HYS', doc_id % 30, ' and AXEC', doc_id % 7, '-', doc_id % 11) WHEN 1 THEN concat(' RS01SLBS-LJ01A-0', doc_id % 9, '-CTDPFA10', doc_id % 3, ' or HYS1', doc_id % 10, ' to HYS', doc_id % 20)
WHEN 2 THEN ' cabled array, HYS12-HYS14 xHYS3' ELSE concat(' AXEC', doc_id % 4, '-HYS', doc_id % 9) END)"""
_NAMES = [
    ("signal", "signal", "cabled array", None), ("context", "axial", "eron", None), ("site", "base", "erth", None), ("site", "ridge", "the thation", None), ("site", "field", "ntly", "axial"),
    ("kind", "ctd", "of a", None), ("kind", "camera", "ered", None), ("system", "one", "thnt", None), ("system", "many", "and to", "axial"), ("feature", "front", "is the", "axial"), ("feature", "rift", "erst", None),
]
_SENSORS = "concat('p', p_partkey) AS sensor, CASE p_partkey % 5 WHEN 0 THEN 'base' WHEN 1 THEN 'ridge' WHEN 2 THEN 'field' END AS site, CASE p_size % 3 WHEN 0 THEN 'ctd' WHEN 1 THEN 'camera' END AS kind"
_VALUES = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in row) + ")" for row in _NAMES)

_SQL = f"""WITH d AS (SELECT 'src' || (doc_id % 61) AS paper, doc_id AS passage, CASE WHEN doc_id % 3 = 0 THEN 'abstract' ELSE 'fulltext' END AS layer, {_TEXT} AS text FROM documents WHERE doc_id % 61 < 58), sensors AS (SELECT {_SENSORS} FROM part WHERE p_partkey <= 40),
codes AS (SELECT concat(CASE WHEN p_partkey % 2 = 0 THEN 'HYS' ELSE 'AXEC' END, p_partkey % 25) AS code, concat('p', p_partkey) AS sensor FROM part WHERE p_partkey <= 40), systems AS (SELECT CASE WHEN p_partkey = 7 THEN 'one' ELSE 'many' END AS system, concat('p', p_partkey) AS sensor, p_partkey <> 7 AS signalled FROM part WHERE p_partkey IN (5, 6, 7, 8, 9, 10)),
names("group", name, phrase, needs) AS (VALUES {_VALUES}), pc AS (SELECT passage, unnest(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9]+')) AS piece, generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9]+'), 1) AS i FROM d),
w AS (SELECT *, sum(length(piece)) OVER (PARTITION BY passage ORDER BY i) AS "end" FROM pc), said AS (SELECT a.passage, n."group", n.name, n.needs, a."end" - length(a.piece) AS start, CASE WHEN contains(n.phrase, ' ') THEN b."end" ELSE a."end" END AS "end"
FROM w a JOIN names n ON a.piece = split_part(n.phrase, ' ', 1) LEFT JOIN w b ON b.passage = a.passage AND b.i = a.i + 2 WHERE NOT contains(n.phrase, ' ') OR b.piece = split_part(n.phrase, ' ', 2)),
nm AS (SELECT DISTINCT passage, piece AS code, "end" - length(piece) AS start FROM w WHERE regexp_matches(piece, '^(HYS|AXEC)[0-9]{{1,2}}$')), named AS (SELECT passage, code, min(start) AS start FROM nm GROUP BY ALL),
rg AS (SELECT a.passage, regexp_extract(a.piece, '^[A-Z]+') AS prefix, regexp_extract(a.piece, '[0-9]+$')::INTEGER AS low, regexp_extract(c.piece, '[0-9]+$')::INTEGER AS high, a."end" - length(a.piece) AS start FROM w a JOIN w b ON b.passage = a.passage AND b.i = a.i + 1 JOIN w c ON c.passage = a.passage AND ((b.piece = '-' AND c.i = a.i + 2) OR (b.piece = ' ' AND c.i = a.i + 4))
LEFT JOIN w t ON t.passage = a.passage AND t.i = a.i + 2 WHERE regexp_matches(a.piece, '^(HYS|AXEC)[0-9]{{1,2}}$') AND regexp_matches(c.piece, '^(HYS|AXEC)?[0-9]{{1,2}}$') AND (b.piece = '-' OR t.piece = 'to') AND regexp_extract(c.piece, '^[A-Z]*') IN ('', regexp_extract(a.piece, '^[A-Z]+'))),
ranged AS (SELECT passage, prefix || n AS code, min(start) AS start FROM (SELECT *, unnest(generate_series(low, high)) AS n FROM rg WHERE low < high AND high <= low + 5) GROUP BY ALL),
sig AS (SELECT DISTINCT paper FROM d WHERE passage IN (SELECT passage FROM said WHERE "group" = 'signal' UNION SELECT passage FROM named)), ok AS (SELECT * FROM said s WHERE needs IS NULL OR passage IN (SELECT passage FROM said c WHERE c."group" = 'context' AND c.name = s.needs)),
k AS (SELECT passage, sensor AS target, 0 AS k, start, NULL::BIGINT AS share FROM named JOIN codes USING (code) UNION ALL SELECT passage, sensor, 1, start, NULL FROM ranged JOIN codes USING (code)
UNION ALL SELECT passage, 'p' || (3 + (passage % 3)), 2, strpos(text, 'RS01SLBS-') - 1, NULL FROM d WHERE passage % 4 = 1 AND passage % 3 < 2
UNION ALL SELECT passage, sensor, 4, min(start), any_value(share) FROM (SELECT s.passage, s.start, s.name AS site, x.name AS kind FROM ok s JOIN said x ON x.passage = s.passage AND x."group" = 'kind' AND x.start >= s.start - 300 AND x."end" <= s."end" + 300 JOIN d ON d.passage = s.passage JOIN sig USING (paper) WHERE s."group" = 'site' AND 2000 + substr(d.paper, 4)::INTEGER % 20 >= 2009) b
JOIN (SELECT *, count(*) OVER (PARTITION BY site, kind) AS share FROM sensors WHERE site IS NOT NULL AND kind IS NOT NULL) USING (site, kind) GROUP BY passage, site, kind, sensor
UNION ALL SELECT passage, sensor, CASE WHEN system = 'one' OR (nearby > 0 AND near) THEN 3 WHEN nearby = 0 AND signal THEN 4 END, start, CASE WHEN system = 'one' THEN NULL WHEN nearby > 0 THEN CASE WHEN nearby > 1 THEN nearby END ELSE 5 END FROM
(SELECT *, count(*) FILTER (WHERE near) OVER (PARTITION BY passage, system) AS nearby FROM (SELECT f.passage, f.system, y.sensor, f.start, d.paper IN (SELECT paper FROM sig) AS signal, EXISTS (SELECT 1 FROM said p JOIN sensors z ON z.site = p.name WHERE z.sensor = y.sensor AND p."group" = 'site' AND p.passage = f.passage AND p.start >= f.start - 600 AND p."end" <= f."end" + 600) AS near
FROM (SELECT passage, name AS system, min(start) AS start, arg_min("end", start) AS "end" FROM ok WHERE "group" = 'system' GROUP BY ALL) f JOIN systems y USING (system) JOIN d ON d.passage = f.passage WHERE NOT y.signalled OR d.paper IN (SELECT paper FROM sig)))
UNION ALL SELECT passage, name, 5, min(start), NULL FROM ok WHERE "group" = 'feature' GROUP BY passage, name),
b AS (SELECT passage, target, arg_min((k, start, share), (k, start, coalesce(share, 0))) AS h FROM k WHERE k IS NOT NULL GROUP BY passage, target), st AS (SELECT passage, count(*) AS stations FROM named GROUP BY passage),
hits AS (SELECT paper, target, passage, ['named', 'range', 'designator', 'system', 'described', 'feature'][h[1] + 1] AS kind, layer, h[2]::BIGINT AS start, h[3]::BIGINT AS share, coalesce(stations, 0) AS stations FROM b JOIN d USING (passage) LEFT JOIN st USING (passage))"""


def _hits(spark, sf):
    d = load(spark, sf, "documents").where("doc_id % 61 < 58")
    layer = F.when(F.col("doc_id") % 3 == 0, "abstract").otherwise("fulltext")
    passages = d.select(F.concat(F.lit("src"), F.col("doc_id") % 61).alias("paper"), F.col("doc_id").alias("passage"), layer.alias("layer"), F.expr(_TEXT).alias("text"))
    papers = passages.select("paper").distinct().withColumn("year", 2000 + F.substring("paper", 4, 9).cast("int") % 20)
    part = load(spark, sf, "part").where("p_partkey <= 40")
    sensor = F.concat(F.lit("p"), "p_partkey").alias("sensor")
    codes = part.select(F.concat(F.when(F.col("p_partkey") % 2 == 0, "HYS").otherwise("AXEC"), F.col("p_partkey") % 25).alias("code"), sensor)
    designators = spark.createDataFrame([("RS01SLBS-LJ01A-CTDPFA100", "p3"), ("RS01SLBS-CTDPFA101", "p4")], "designator string, sensor string")
    designators = designators.select(F.when(F.length("designator") < 20, "RS01SLBS-MJ09Z-02-CTDPFA101").otherwise(F.col("designator")).alias("designator"), "sensor")
    names = spark.createDataFrame(_NAMES, "group string, name string, phrase string, needs string")
    sensors = part.selectExpr(*_SENSORS.replace(", CASE", "\n CASE").split("\n "))
    systems = part.where("p_partkey IN (5, 6, 7, 8, 9, 10)").select(F.when(F.col("p_partkey") == 7, "one").otherwise("many").alias("system"), sensor, (F.col("p_partkey") != 7).alias("signalled"))
    return candidates.candidate_links(passages, papers, codes, designators, names, sensors, systems, "(?:HYS|AXEC)[0-9]{1,2}", ["HYS", "AXEC"]), papers


@query(f"{_SQL} SELECT * FROM hits")
def candidate_links(spark, sf):
    return _hits(spark, sf)[0]


@query(f"""{_SQL}, h AS (SELECT *, passage % 4 = 0 AS use FROM hits), p AS (SELECT DISTINCT paper, 2000 + substr(paper, 4)::INTEGER % 20 AS year FROM d),
a AS (SELECT paper, target AS sensor, count(*) AS n, count(*) FILTER (WHERE use) AS n_use, bool_or(kind IN ('named', 'range', 'designator')) AS coded, bool_or(kind = 'system') AS system, bool_or(layer = 'fulltext') AS fulltext, bool_or(use AND layer = 'abstract') AS abstract_use,
min(CASE WHEN share > 0 THEN share ELSE 1 END) AS share, bool_or(stations >= 3) AS tabled FROM h GROUP BY paper, target)
SELECT * FROM (SELECT paper, sensor, n, n_use, CASE WHEN year < 2013 THEN CASE WHEN coded OR system THEN 'mentioned' END WHEN NOT fulltext THEN CASE WHEN coded OR system OR (share <= 2 AND abstract_use) THEN 'used' END WHEN coded THEN CASE WHEN n >= 3 OR n_use >= 1 THEN 'used' ELSE 'mentioned' END
WHEN system THEN CASE WHEN n_use >= 2 OR abstract_use THEN 'used' ELSE 'mentioned' END WHEN share <= 2 THEN CASE WHEN n_use >= 2 OR abstract_use THEN 'used' WHEN n_use > 0 THEN 'mentioned' END WHEN (abstract_use AND n_use >= 3) OR n_use >= 6 THEN 'used' END AS relation FROM a JOIN p USING (paper)) WHERE relation IS NOT NULL""")
def links_from_passages(spark, sf):
    """Candidate links, judged: from documents to relations without a step by hand."""
    found, papers = _hits(spark, sf)
    hits = found.select("paper", F.col("target").alias("sensor"), F.col("passage").alias("hit"), "kind", "layer", (F.col("passage") % 4 == 0).alias("use"), "share", "stations")
    papers = papers.select("paper", "year", F.lit(False).alias("overview"), F.lit(False).alias("on_topic"))
    return linking.judge_links(hits, papers).select("paper", "sensor", "n", "n_use", "relation")
