"""Links between papers, sensors and sites, and choices among candidates, as aggregates over small keys.

Every rule is a conditional aggregate followed by one CASE, so a hot paper or sensor
is reduced on the map side and never gathered into a list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of a hit that carry a code, and the first year with sensors in the water.
CODED = ("named", "range", "designator")
FIRST_YEAR = 2013
#: Variables that are no measurement, and readings that come beside a sensor's own.
NOT_MEASURED = r"(?i)_qc_|^(?:time|latitude|longitude|z|depth|station|deployment|id|predtide|botsflu_predtide)$"
CO_LOCATED = r"(?i)^(?:depth_reading|sea_water_(?:pressure|temperature|practical_salinity|density|electrical_conductivity))(?:_|$)"


def judge_links(hits: DataFrame, papers: DataFrame) -> DataFrame:
    """(paper, sensor, relation, n, n_use, best): 'used' or 'mentioned'; links too vague for either have no row.

    ``hits`` has paper, sensor, hit (an id), kind, layer ('abstract' or 'fulltext'), use (the passage is about data),
    share (sensors that the wording fits; null or 0 counts as 1) and stations (codes in the passage); ``papers`` has
    paper, year (null or 0: unknown), overview and on_topic (its abstract is about such data). A hit's null use counts
    as false, and papers without a row count as of unknown year, no overview and off topic. ``best`` is the hit that
    shows the link best: about data, coded, of a system, of the full text, then the smaller id.
    """
    use, kind = F.coalesce("use", F.lit(False)), F.coalesce("kind", F.lit(""))
    coded, named = kind.isin(*CODED), kind == "system"
    links = hits.groupBy("paper", "sensor").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(use).alias("n_use"),
        F.max(coded).alias("coded"),
        F.max(named).alias("system"),
        F.max(F.coalesce(F.col("layer") == "fulltext", F.lit(False))).alias("fulltext"),
        F.max(use & F.coalesce(F.col("layer") == "abstract", F.lit(False))).alias("abstract_use"),
        F.min(F.when(F.col("share") > 0, F.col("share")).otherwise(1)).alias("share"),
        F.max(F.coalesce(F.col("stations") >= 3, F.lit(False))).alias("table"),
        F.min_by("hit", F.struct(~use, ~coded, ~named, F.coalesce(F.col("layer") != "fulltext", F.lit(True)), F.col("hit"))).alias("best"),
    )
    c = F.col
    firm, about = c("coded") | c("system"), (c("n_use") >= 2) | c("abstract_use")
    used, mentioned, vague = F.lit("used"), F.lit("mentioned"), F.lit(None).cast("string")
    rules = [
        (c("year").between(1, FIRST_YEAR - 1), F.when(firm, mentioned).otherwise(vague)),
        (c("overview"), F.when(firm | (c("share") <= 2), mentioned).otherwise(vague)),
        (~c("fulltext"), F.when(firm | ((c("share") <= 2) & c("abstract_use")), used).otherwise(vague)),
        (c("coded"), F.when((c("n") >= 3) | (c("n_use") >= 1) | (c("table") & c("on_topic")), used).otherwise(mentioned)),
        (c("system"), F.when(about, used).otherwise(mentioned)),
        (c("share") <= 2, F.when(about, used).when(c("n_use") > 0, mentioned).otherwise(vague)),
    ]
    relation = F.when((c("abstract_use") & (c("n_use") >= 3)) | (c("n_use") >= 6), used).otherwise(vague)
    for condition, value in reversed(rules):
        relation = F.when(condition, value).otherwise(relation)
    return links.join(papers.select("paper", "year", "overview", "on_topic"), "paper", "left").select("paper", "sensor", relation.alias("relation"), "n", "n_use", "best").where("relation IS NOT NULL")


def study_sites(used: DataFrame, named: DataFrame, prefixes: list[tuple[str, str]], parents: list[tuple[str, str]]) -> DataFrame:
    """(paper, site, why): sites a paper names, else where its sensors are, and the broader site of each.

    ``used`` has paper, place (a sensor's code); ``named`` has paper, site. Sensors speak only when all share the
    first four characters of their places. ``prefixes`` are (site, code prefix) and ``parents`` (site, broader
    site), both fixed lists. A site's own finding stands before one implied by a narrower site, the first in ``parents``.
    """
    spark = used.sparkSession
    one = used.where("place IS NOT NULL").groupBy("paper").agg(F.min("place").alias("first"), F.min(F.substring("place", 1, 4)).alias("low"), F.max(F.substring("place", 1, 4)).alias("high"))
    alone = used.join(one.where("low = high").select("paper"), "paper", "left_semi")
    site = F.explode(F.filter(F.array(*[F.when(F.col("place").startswith(p), s) for s, p in prefixes]), lambda x: x.isNotNull()))
    there = alone.select("paper", site.alias("site"), F.lit("sensors").alias("why"), F.lit(1).alias("k"))
    own = named.select("paper", "site", F.lit("named").alias("why"), F.lit(0).alias("k")).unionByName(there)
    own = own.groupBy("paper", "site").agg(F.min_by("why", "k").alias("why"))
    up = spark.createDataFrame([(s, p, i + 1) for i, (s, p) in enumerate(parents)], "site string, parent string, level int")
    implied = own.join(F.broadcast(up), "site").select("paper", F.col("parent").alias("site"), "why", "level")  # a fixed list
    return own.withColumn("level", F.lit(0)).unionByName(implied).groupBy("paper", "site").agg(F.min_by("why", "level").alias("why"))


def measured_variables(variables: DataFrame) -> DataFrame:
    """(dataset, variable) rows of a dataset's own measurements; readings beside them stay where nothing else is there."""
    m = variables.where(~F.col("variable").rlike(NOT_MEASURED)).withColumn("_beside", F.col("variable").rlike(CO_LOCATED))
    own = m.groupBy("dataset").agg(F.bool_or(~F.col("_beside")).alias("_own"))
    return m.join(own, "dataset").where(~F.col("_beside") | ~F.col("_own")).drop("_beside", "_own")


def fresh_or_lower(readings: DataFrame, channels: list[str], now, stale: float) -> DataFrame:
    """(station, channel, lag): the first of ``channels``, unless it is missing or ``stale`` behind ``now`` and a later one is not.

    ``readings`` has station, channel, t (seconds); ``now`` is a column of it that does not vary. A station without
    a current channel keeps the first one and its lag (null: none at all).
    """
    lags = readings.groupBy("station").agg(F.max(now).alias("_now"), *[F.max(F.when(F.col("channel") == c, F.col("t"))).alias(f"_t{i}") for i, c in enumerate(channels)])
    lag = [F.col("_now") - F.col(f"_t{i}") for i in range(len(channels))]
    chosen = F.coalesce(F.when(lag[0] < stale, F.struct(F.lit(channels[0]).alias("channel"), lag[0].alias("lag"))), *[F.when(g <= stale, F.struct(F.lit(c).alias("channel"), g.alias("lag"))) for c, g in zip(channels[1:], lag[1:])], F.struct(F.lit(channels[0]).alias("channel"), lag[0].alias("lag")))
    return lags.select("station", chosen.alias("_c")).select("station", "_c.channel", "_c.lag")


def cited_or_first(evidence: DataFrame, answers: DataFrame, n: int = 3) -> DataFrame:
    """Evidence (answer, place) whose place the answer's text cites as [place]; an answer that cites none of its own gets the first ``n``."""
    cited = F.transform(F.regexp_extract_all("text", F.lit(r"\[([0-9]{1,9})\]"), 1), lambda x: x.cast("long"))
    e = evidence.join(answers.select("answer", cited.alias("_cited")), "answer").withColumn("_hit", F.array_contains("_cited", F.col("place").cast("long")))
    any_hit = e.groupBy("answer").agg(F.bool_or("_hit").alias("_any"))
    return e.join(any_hit, "answer").where(F.col("_hit") | (~F.col("_any") & (F.col("place") <= n))).drop("_cited", "_hit", "_any")


def expand_seeds(edges: DataFrame, seeds: DataFrame, depth: int, fan_out: int = 25, limit: int = 250, most: int = 20) -> DataFrame:
    """(seed, node, depth, direction, pred): walks from several seeds that share one budget, the seeds themselves left out.

    ``seeds`` has seed (its place) and node; the first ``most`` count. Each walk is bounded as in
    ``graph.neighbours``; each call's own row takes one of what is left, so ``limit`` - 1 rows come back at most,
    earlier seeds first. These bounds are the operator's feature.
    """
    from ..sources.shared import materialize

    depth = max(0, min(depth, 3))
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"), F.lit("out").alias("direction"), "pred")
    both = out.unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("next"), F.lit("in").alias("direction"), "pred"))
    frontier = seeds.select("seed", "node").orderBy("seed").limit(most)
    found = frontier.select("seed", "node", F.lit(0).alias("depth"), F.lit("self").alias("direction"), F.lit("SELF").alias("pred"))
    for level in range(1, depth + 1):
        per = Window.partitionBy("node", "direction").orderBy("next", "pred")
        near = both.join(frontier.select("node").distinct(), "node", "left_semi").withColumn("k", F.row_number().over(per)).where(F.col("k") <= fan_out)
        step = near.join(frontier, "node").groupBy("seed", "next").agg(F.min(F.struct("direction", "pred")).alias("e"))
        step = step.select("seed", F.col("next").alias("node"), F.lit(level).alias("depth"), "e.direction", "e.pred").join(found.select("seed", "node"), ["seed", "node"], "left_anti")
        step = materialize(step, "level")
        frontier, found = step.select("seed", "node"), found.unionByName(step)
    return found.where("depth > 0").orderBy("seed", "depth", "node").limit(max(0, min(limit, 250) - 1))
