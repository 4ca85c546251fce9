"""Joins, aggregations, windows, sorts and set operations over the star schema and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import joins, windows
from ..sources.tables import epoch_seconds, load
from .registry import query

T = "epoch_us(ts) / 1e6"


# --- joins -------------------------------------------------------------------------------------------------------


@query("SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' GROUP BY n_name")
def join_inner(spark, sf):
    n = load(spark, sf, "nation").join(load(spark, sf, "region").where("r_name <> 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return load(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""SELECT coalesce(c.k, s.k) AS nation, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers FROM
(SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c FULL OUTER JOIN (SELECT s_nationkey + 4 AS k, count(*) AS n FROM supplier GROUP BY 1) s ON c.k = s.k""")
def join_full_outer(spark, sf):
    """Keys shifted by four, so that either side has some that the other lacks."""
    c = load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("c"))
    s = load(spark, sf, "supplier").groupBy((F.col("s_nationkey") + 4).alias("nation")).agg(F.count(F.lit(1)).alias("s"))
    return c.join(s, "nation", "full_outer").select("nation", F.coalesce("c", F.lit(0)).alias("customers"), F.coalesce("s", F.lit(0)).alias("suppliers"))


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT' GROUP BY c_custkey")
def join_left_outer(spark, sf):
    o = load(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    return load(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))


@query("WITH p AS (SELECT avg(o_totalprice) AS a FROM orders) SELECT o_orderpriority, count(*) AS above FROM orders, p WHERE o_totalprice > a GROUP BY 1")
def join_one_row_parameters(spark, sf):
    o = load(spark, sf, "orders")
    p = o.agg(F.avg("o_totalprice").alias("a"))  # one row by construction
    return o.join(F.broadcast(p), F.col("o_totalprice") > F.col("a")).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("above"))


@query("""SELECT c_custkey, o_orderkey, round(o_totalprice, 2) AS price FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY
CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END, o_orderkey) AS rn FROM orders) o ON o_custkey = c_custkey AND rn = 1""")
def lateral_top_one(spark, sf):
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(3)
    o = load(spark, sf, "orders").groupBy("o_custkey").agg(F.min_by(F.struct("o_orderkey", "o_totalprice"), F.struct(rank, "o_orderkey")).alias("o"))
    return load(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o.o_orderkey", F.round("o.o_totalprice", 2).alias("price"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem) WHERE rank <= 25")
def lateral_top_k(spark, sf):
    l = load(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return joins.top_per_group(l, ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"], 25).select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@query(r"""WITH t(term) AS (VALUES ('ring'), ('widget'), ('red'), ('small')) SELECT term, count(*) AS parts FROM part JOIN t ON strpos(p_name, term) > 0 AND regexp_matches(p_name, '(^|[^A-Za-z0-9])' || term || '([^A-Za-z0-9]|$)') GROUP BY term""")
def theta_join_terms(spark, sf):
    terms = spark.createDataFrame([("ring",), ("widget",), ("red",), ("small",)], "term string")  # a fixed list
    named = F.expr("instr(p_name, term) > 0 AND p_name RLIKE concat('(^|[^A-Za-z0-9])', term, '([^A-Za-z0-9]|$)')")
    return load(spark, sf, "part").join(F.broadcast(terms), named).groupBy("term").agg(F.count(F.lit(1)).alias("parts"))


@query(f"""WITH r AS (SELECT user_id, {T} AS t0, {T} + 900 AS t1, event_id FROM events WHERE event_type = 'error')
SELECT r.event_id, count(*) AS inside FROM r JOIN events e ON e.user_id = r.user_id AND {T.replace('ts', 'e.ts')} BETWEEN t0 AND t1 GROUP BY r.event_id""")
def range_join(spark, sf):
    e = load(spark, sf, "events").select("user_id", "event_type", "event_id", epoch_seconds("ts").alias("t"))
    r = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("id"), F.col("t").alias("t0"), F.explode(F.array(F.floor(F.col("t") / 900), F.floor(F.col("t") / 900) + 1)).alias("slot"))
    inside = e.withColumn("slot", F.floor(F.col("t") / 900)).join(r, ["user_id", "slot"]).where("t BETWEEN t0 AND t0 + 900")
    return inside.groupBy(F.col("id").alias("event_id")).agg(F.count(F.lit(1)).alias("inside"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def join_semi(spark, sf):
    return load(spark, sf, "customer").join(load(spark, sf, "orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, sf):
    return load(spark, sf, "customer").join(load(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT s_suppkey, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey OR s_suppkey % 25 = n_nationkey GROUP BY s_suppkey")
def join_disjunctive(spark, sf):
    s, n = load(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), load(spark, sf, "nation").select("n_nationkey")
    a = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    b = s.join(n, F.col("s_suppkey") % 25 == F.col("n_nationkey"))
    return a.unionByName(b).distinct().groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH alias AS (SELECT p_partkey AS id, lower(p_brand) AS a FROM part UNION SELECT p_partkey, lower(p_type) FROM part), seed AS (SELECT a FROM alias WHERE id = 7)
SELECT DISTINCT id FROM alias WHERE a IN (SELECT a FROM seed)""")
def join_alias_closure(spark, sf):
    p = load(spark, sf, "part")
    alias = p.select(F.col("p_partkey").alias("id"), F.explode(F.array(F.lower("p_brand"), F.lower("p_type"))).alias("a"))
    return alias.join(alias.where("id = 7").select("a").distinct(), "a", "left_semi").select("id").distinct()


@query(f"""WITH l AS (SELECT event_id, user_id, {T} AS t FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, {T} AS t, value FROM events WHERE event_type = 'view')
SELECT l.event_id, round(r.t, 3) AS matched_at, r.value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t >= r.t""")
def join_as_of(spark, sf):
    e = load(spark, sf, "events").select("event_id", "user_id", "event_type", "value", epoch_seconds("ts").alias("t"))
    l = e.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    return joins.as_of_backward(l, e.where("event_type = 'view'"), ["user_id"], "t", ["value"]).select("event_id", F.round("matched_at", 3).alias("matched_at"), "value")


@query(f"""WITH l AS (SELECT event_id, user_id, {T} AS t FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, {T} AS t, value FROM events WHERE event_type = 'signup'),
b AS (SELECT l.event_id, l.t, r.t AS m, r.value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t >= r.t), f AS (SELECT user_id, arg_min(value, t) AS value FROM r GROUP BY user_id)
SELECT b.event_id, coalesce(b.value, f.value) AS value FROM b JOIN l USING (event_id) LEFT JOIN f USING (user_id)""")
def join_as_of_else_first(spark, sf):
    e = load(spark, sf, "events").select("event_id", "user_id", "event_type", "value", epoch_seconds("ts").alias("t"))
    l = e.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    return joins.as_of_backward(l, e.where("event_type = 'signup'"), ["user_id"], "t", ["value"], or_first=True).select("event_id", "value")


@query(f"""WITH l AS (SELECT event_id, user_id, {T} AS t FROM events WHERE event_type = 'click'), r AS (SELECT event_id, user_id, {T} AS t FROM events WHERE event_type = 'error')
SELECT l.event_id AS left_id, arg_min(r.event_id, (abs(l.t - r.t), r.t, r.event_id)) AS right_id FROM l LEFT JOIN r ON l.user_id = r.user_id AND abs(l.t - r.t) <= 3600 GROUP BY l.event_id""")
def join_nearest_in_time(spark, sf):
    e = load(spark, sf, "events").select("event_id", "user_id", "event_type", epoch_seconds("ts").alias("t"))
    return joins.nearest_in_time(e.where("event_type = 'click'"), e.where("event_type = 'error'"), ["user_id"], "t", "event_id", "event_id", 3600.0)


@query(f"""WITH l AS (SELECT event_id, user_id, {T} AS t FROM events WHERE event_type = 'click'), r AS (SELECT event_id, user_id, {T} AS t FROM events WHERE event_type = 'purchase')
SELECT l.event_id AS left_id, arg_min(r.event_id, (r.t, r.event_id)) AS right_id FROM l JOIN r ON l.user_id = r.user_id AND r.t >= l.t AND r.t - l.t <= 7200 GROUP BY l.event_id""")
def join_first_within(spark, sf):
    e = load(spark, sf, "events").select("event_id", "user_id", "event_type", epoch_seconds("ts").alias("t"))
    return joins.first_within(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), ["user_id"], "t", "event_id", "event_id", 7200.0)


@query("""WITH c AS (SELECT o_orderkey, o_orderdate::DATE AS a FROM orders WHERE o_orderstatus = 'F'), d AS (SELECT o_orderkey, a, unnest(generate_series(a, a + INTERVAL 3 DAY, INTERVAL 1 DAY))::DATE AS day FROM c),
f AS (SELECT day, arg_min(o_orderkey, (a, o_orderkey)) AS cruise FROM d GROUP BY day) SELECT l_orderkey, l_linenumber, l_partkey, cruise FROM lineitem JOIN f ON l_shipdate::DATE = day""")
def interval_stab(spark, sf):
    """The first cruise that covers a stop's day; the answer hangs on the day alone, so days are settled before the join."""
    c = load(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.to_date("o_orderdate").alias("a"))
    first = c.withColumn("day", F.explode(F.sequence("a", F.date_add("a", 3)))).groupBy("day").agg(F.min_by("o_orderkey", F.struct("a", "o_orderkey")).alias("cruise"))
    s = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.to_date("l_shipdate").alias("day"))
    return s.join(first, "day").drop("day")


_SITES = "s AS (SELECT c_custkey AS id, (c_custkey * 37 % 1200) / 10.0 - 60 AS lat, (c_custkey * 91 % 3400) / 10.0 - 170 AS lon FROM customer)"


def _sites(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    return load(spark, sf, "customer").select(k.alias("id"), (k * 37 % 1200 / 10.0 - 60).alias("lat"), (k * 91 % 3400 / 10.0 - 170).alias("lon"))


@query(f"""WITH {_SITES}, p AS (SELECT a.id AS lid, b.id AS rid, 2 * 6371.0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) AS km
FROM s a JOIN s b ON a.id < b.id AND abs(a.lat - b.lat) < 4) SELECT lid, rid, round(km, 4) AS km FROM p WHERE km <= 300""")
def radius_join(spark, sf):
    s = _sites(spark, sf)
    pairs = joins.within_radius(s.withColumnRenamed("id", "lid"), s.withColumnRenamed("id", "rid"), 300.0)
    return pairs.where("lid < rid").select("lid", "rid", F.round("km", 4).alias("km"))


@query("""WITH o AS (SELECT unnest(generate_series(1, 5)) AS ord, unnest([40, 7, 40, 999999, 3]) AS id) SELECT ord, id, p_name FROM o LEFT JOIN part ON p_partkey = id""")
def ordinal_lookup(spark, sf):
    ids = spark.createDataFrame([([40, 7, 40, 999999, 3],)], "ids array<bigint>").select(F.posexplode("ids").alias("pos", "id"))
    return ids.join(load(spark, sf, "part"), F.col("id") == F.col("p_partkey"), "left").select((F.col("pos") + 1).cast("long").alias("ord"), F.col("id").cast("int").alias("id"), "p_name").orderBy("ord")


@query("""SELECT o_orderkey, lag(o_orderkey) OVER w AS previous, CASE WHEN lag(o_orderstatus) OVER w <> o_orderstatus THEN 'status' END AS changed FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def successor_join(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return load(spark, sf, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("previous"), F.when(F.lag("o_orderstatus").over(w) != F.col("o_orderstatus"), "status").alias("changed"))


# --- aggregations ------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types FROM events")
def count_distinct(spark, sf):
    return load(spark, sf, "events").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.countDistinct("event_type").alias("types"))


@query("SELECT count(*) FILTER (WHERE value > 100) AS high, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) AS n FROM events")
def filtered_counts(spark, sf):
    return load(spark, sf, "events").agg(F.count_if(F.col("value") > 100).alias("high"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, round(sum(value), 4) AS total, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types FROM events GROUP BY user_id")
def sum_and_distinct_array(spark, sf):
    return load(spark, sf, "events").groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("total"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"))


@query("SELECT user_id, arg_min(event_id, (-value, event_id)) AS best, max(value) AS value FROM events GROUP BY user_id")
def arg_max(spark, sf):
    return load(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct(-F.col("value"), "event_id")).alias("best"), F.max("value").alias("value"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 15")
def having(spark, sf):
    return load(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n >= 15")


@query("""SELECT strftime(ts, '%Y-%m') AS period, event_type, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, arg_min(event_id, (-coalesce(value, -999), ts, event_id)) AS largest FROM events GROUP BY ALL
UNION ALL SELECT strftime(ts, '%Y-%m-%d'), event_type, count(*), min(value), max(value), round(avg(value), 6), arg_min(event_id, (-coalesce(value, -999), ts, event_id)) FROM events GROUP BY ALL""")
def period_rollups(spark, sf):
    e = load(spark, sf, "events").select("event_id", "ts", "event_type", "value", F.explode(F.array(F.date_format("ts", "yyyy-MM"), F.date_format("ts", "yyyy-MM-dd"))).alias("period"))
    return e.groupBy("period", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"),
        F.min_by("event_id", F.struct(-F.coalesce("value", F.lit(-999.0)), "ts", "event_id")).alias("largest"),
    )


@query("""WITH d AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, sum(n)::BIGINT AS total, array_to_string(list_sort(list(day || '=' || n)), ';') AS daily FROM d GROUP BY user_id""")
def activity_summary(spark, sf):
    d = load(spark, sf, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return d.groupBy("user_id").agg(F.sum("n").alias("total"), F.array_join(F.array_sort(F.collect_list(F.concat("day", F.lit("="), F.col("n").cast("string")))), ";").alias("daily"))


@query("SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS place FROM documents GROUP BY source")
def frequency_table(spark, sf):
    c = load(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return c.select("source", "n", F.row_number().over(Window.orderBy(F.desc("n"), "source")).cast("long").alias("place"))  # one row per source


@query("SELECT coalesce(event_type, CASE WHEN grouping(event_type) = 1 THEN '*' END) AS event_type, coalesce(hour, -1) AS hour, count(*) AS n FROM (SELECT event_type, hour(ts) AS hour FROM events) GROUP BY GROUPING SETS ((event_type), (hour), ())")
def multi_dimension_counts(spark, sf):
    e = load(spark, sf, "events").select("event_type", F.hour("ts").cast("long").alias("hour"))
    g = e.groupingSets([["event_type"], ["hour"], []], "event_type", "hour").agg(F.count(F.lit(1)).alias("n"), F.grouping("event_type").alias("g"))
    return g.select(F.coalesce("event_type", F.when(F.col("g") == 1, "*")).alias("event_type"), F.coalesce("hour", F.lit(-1)).alias("hour"), "n")


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, max(value) AS v FROM events GROUP BY ALL)
SELECT user_id, count(*) AS days, count(*) FILTER (WHERE n < 3) AS thin_days, count(*) FILTER (WHERE v > 150) AS wild_days, sum(n)::BIGINT AS total, round(count(*) / 30.0, 6) AS coverage, arg_max(n, day) AS latest FROM d GROUP BY user_id""")
def metric_summary(spark, sf):
    d = load(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("v"))
    return d.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("days"), F.count_if(F.col("n") < 3).alias("thin_days"), F.count_if(F.col("v") > 150).alias("wild_days"),
        F.sum("n").alias("total"), F.round(F.count(F.lit(1)) / 30.0, 6).alias("coverage"), F.max_by("n", "day").alias("latest"),
    )


@query("""WITH o AS (SELECT c_mktsegment AS segment, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY ALL), r AS (SELECT min(month) AS lo, max(month) AS hi FROM o),
m AS (SELECT segment, unnest(generate_series(lo, hi, INTERVAL 1 MONTH))::DATE AS month FROM (SELECT DISTINCT segment FROM o), r)
SELECT segment, strftime(month, '%Y-%m') AS month, coalesce(n, 0) AS n FROM m LEFT JOIN o USING (segment, month)""")
def dense_month_counts(spark, sf):
    """Urgent orders a month and segment on a calendar from the first month to the last, empty months as zero."""
    o = load(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.groupBy(F.col("c_mktsegment").alias("segment"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    r = o.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    m = o.select("segment").distinct().crossJoin(F.broadcast(r)).select("segment", F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias("d"))
    return m.join(o, ["segment", "d"], "left").select("segment", F.date_format("d", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, CASE WHEN count(*) >= 60 THEN round(quantile_cont(value, 0.5), 6) END AS median FROM events GROUP BY ALL")
def resample_daily(spark, sf):
    n = F.count(F.lit(1))
    return load(spark, sf, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        n.alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"), F.when(n >= 60, F.round(F.percentile("value", 0.5), 6)).alias("median")
    )


@query("SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(1.4826 * mad(value), 6) AS robust_sd FROM events GROUP BY event_type")
def percentiles(spark, sf):
    e = load(spark, sf, "events").select("event_type", "value")
    p = e.groupBy("event_type").agg(*[F.percentile("value", q).alias(n) for q, n in ((0.05, "p05"), (0.5, "p50"), (0.95, "p95"))])
    m = e.join(F.broadcast(p), "event_type").groupBy("event_type").agg(F.percentile(F.abs(F.col("value") - F.col("p50")), 0.5).alias("mad"))
    return p.join(m, "event_type").select("event_type", *[F.round(c, 6).alias(c) for c in ("p05", "p50", "p95")], F.round(1.4826 * F.col("mad"), 6).alias("robust_sd"))


@query("""WITH v AS (SELECT user_id, value * cos(radians(event_id % 360)) AS u, value * sin(radians(event_id % 360)) AS w FROM events)
SELECT user_id, round(sqrt(avg(u) * avg(u) + avg(w) * avg(w)), 6) AS speed, round(((degrees(atan2(avg(u), avg(w))) % 360) + 360) % 360, 4) AS direction FROM v GROUP BY user_id""")
def vector_average(spark, sf):
    a = F.radians(F.col("event_id") % 360)
    v = load(spark, sf, "events").select("user_id", (F.col("value") * F.cos(a)).alias("u"), (F.col("value") * F.sin(a)).alias("w"))
    m = v.groupBy("user_id").agg(F.avg("u").alias("u"), F.avg("w").alias("w"))
    return m.select("user_id", F.round(F.hypot("u", "w"), 6).alias("speed"), F.round(F.pmod(F.degrees(F.atan2("u", "w")), F.lit(360.0)), 4).alias("direction"))


@query("""WITH w AS (SELECT user_id, event_type, sum(CASE event_type WHEN 'purchase' THEN 100 ELSE 1 END) AS w FROM events GROUP BY ALL) SELECT user_id, arg_max(event_type, (w, event_type)) AS majority FROM w GROUP BY user_id""")
def weighted_majority(spark, sf):
    w = load(spark, sf, "events").groupBy("user_id", "event_type").agg(F.sum(F.when(F.col("event_type") == "purchase", 100).otherwise(1)).alias("w"))
    return w.groupBy("user_id").agg(F.max_by("event_type", F.struct("w", "event_type")).alias("majority"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, avg(value) AS v FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL), x AS (SELECT a.day, a.v - b.v AS diff FROM d a JOIN d b ON a.day = b.day AND a.event_type = 'click' AND b.event_type = 'view')
SELECT strftime(day, '%Y-%m-%d') AS day, round(diff - first_value(diff) OVER (ORDER BY day), 6) AS uplift FROM x""")
def daily_differential(spark, sf):
    d = load(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).pivot("event_type", ["click", "view"]).agg(F.avg("value"))
    x = d.where("click IS NOT NULL AND view IS NOT NULL").select("day", (F.col("click") - F.col("view")).alias("diff"))
    return x.select("day", F.round(F.col("diff") - F.first("diff").over(Window.orderBy("day")), 6).alias("uplift"))  # one row per day


@query("""SELECT role, count(*) AS runs, round(sum(((length(text) // 4) * 4.0 + turn * 20 + (length(text) // 40) * 0.4) / 1e6), 8) AS usd FROM conversations GROUP BY role""")
def cost_by_model(spark, sf):
    tokens, cached = F.floor(F.length("text") / 4), F.floor(F.length("text") / 40)
    return load(spark, sf, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("runs"), F.round(F.sum((tokens * 4.0 + F.col("turn") * 20 + cached * 0.4) / 1e6), 8).alias("usd"))


@query("""WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY lang = 'en', n DESC, lang) AS k FROM c) SELECT source, lang, n, k FROM r WHERE k <= 3""")
def top_mentions(spark, sf):
    c = load(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return joins.top_per_group(c, ["source"], [F.col("lang") == "en", F.desc("n"), "lang"], 3, "k")


@query("SELECT sha256(text) AS content, min(doc_id) AS canonical, count(*) - 1 AS aliases FROM documents GROUP BY 1")
def dedup_by_content(spark, sf):
    return load(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("content")).agg(F.min("doc_id").alias("canonical"), (F.count(F.lit(1)) - 1).alias("aliases"))


@query("SELECT l_orderkey, l_linenumber, arg_max(l_partkey, (l_shipdate, l_partkey)) AS latest FROM lineitem GROUP BY ALL")
def dedup_keep_latest(spark, sf):
    return load(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max_by("l_partkey", F.struct("l_shipdate", "l_partkey")).alias("latest"))


@query("SELECT o_custkey, o_orderstatus, count(*) AS n, array_to_string(list_sort(list(DISTINCT o_orderkey))::VARCHAR[], '|') AS files FROM orders GROUP BY ALL")
def consolidate_notes(spark, sf):
    """Every file of a note (a customer's orders of one status) is kept."""
    return load(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("o_orderkey")).cast("array<string>"), "|").alias("files"))


@query("SELECT 'orders' AS collection, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'pages', count(*) FROM pages")
def build_totals(spark, sf):
    out = None
    for name in ("orders", "lineitem", "documents", "pages"):
        one = load(spark, sf, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("collection"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 6) AS avg_qty, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY ALL")
def pricing_summary(spark, sf):
    l = load(spark, sf, "lineitem").where("l_shipdate <= timestamp'2001-09-02'")
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count(F.lit(1)).alias("count_order"),
    )


# --- windows, sorts, limits, sets --------------------------------------------------------------------------------


@query("SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC NULLS LAST, doc_id) AS place FROM documents")
def rank_nulls_last(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc_nulls_last("n_chars"), "doc_id")).cast("long").alias("place"))


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderstatus FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey")
def distinct_on(spark, sf):
    o = load(spark, sf, "orders").groupBy("o_custkey").agg(F.min_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey")).alias("o"))
    return o.select("o_custkey", "o.o_orderkey", "o.o_orderstatus")


@query("SELECT event_id, round(sum(value) OVER w, 4) AS running, max(value) OVER w AS peak FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_sums(spark, sf):
    r = windows.running(load(spark, sf, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], "value")
    return r.select("event_id", F.round("running_sum", 4).alias("running"), F.col("running_max").alias("peak"))


@query("""SELECT event_id, CASE WHEN count(*) OVER e = 24 THEN round(avg(value) OVER e, 6) END AS even_mean, CASE WHEN count(*) OVER o = 25 THEN round(avg(value) OVER o, 6) END AS odd_mean
FROM events WINDOW e AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING), o AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)""")
def rolling_means(spark, sf):
    n = F.count(F.lit(1))

    def means(frame):
        e, o = frame(-12, 11), frame(-12, 12)
        return [F.when(n.over(e) == 24, F.round(F.avg("value").over(e), 6)).alias("even_mean"), F.when(n.over(o) == 25, F.round(F.avg("value").over(o), 6)).alias("odd_mean")]

    events = load(spark, sf, "events").select("event_type", "ts", "event_id", "value")
    return windows.over_rows(events, ["event_type"], ["ts", "event_id"], 12, 12, means).select("event_id", "even_mean", "odd_mean")


@query("SELECT event_id, CASE WHEN count(*) OVER w >= 8 THEN round(quantile_cont(value, 0.5) OVER w, 6) END AS med FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)")
def rolling_median(spark, sf):
    def median(frame):
        w = frame(-7, 7)
        return [F.when(F.count(F.lit(1)).over(w) >= 8, F.round(F.percentile("value", 0.5).over(w), 6)).alias("med")]

    events = load(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    return windows.over_rows(events, ["user_id"], ["ts", "event_id"], 7, 7, median).select("event_id", "med")


@query("""WITH r AS (SELECT doc_id, source, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM documents), c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY place) AS k FROM r)
SELECT doc_id, source, place FROM c WHERE k <= 2 ORDER BY place LIMIT 8""")
def cap_per_group(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "source", "n_chars")
    capped = joins.top_per_group(d, ["source"], [F.desc("n_chars"), "doc_id"], 2, "k")
    # A row's place among all rows is needed for few rows only: count what stands before each of them.
    best = capped.orderBy(F.desc("n_chars"), "doc_id").limit(8)
    ahead = d.select(F.col("n_chars").alias("c"), F.col("doc_id").alias("i"))
    placed = ahead.join(F.broadcast(best), (F.col("c") > F.col("n_chars")) | ((F.col("c") == F.col("n_chars")) & (F.col("i") <= F.col("doc_id"))))
    return placed.groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("place"))


@query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS pos, 1 AS list FROM documents), b AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS pos, 2 AS list FROM documents),
u AS (SELECT * FROM a WHERE pos <= 20 UNION ALL SELECT * FROM b WHERE pos <= 20), f AS (SELECT doc_id, min((pos, list)) AS first FROM u GROUP BY doc_id)
SELECT doc_id, row_number() OVER (ORDER BY first) AS place FROM f""")
def interleave_lists(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "n_chars")
    lists = []
    for i, order in enumerate(([F.desc("n_chars"), "doc_id"], ["n_chars", "doc_id"]), 1):
        top = d.orderBy(*order).limit(20)
        lists.append(top.select("doc_id", F.row_number().over(Window.orderBy(*order)).alias("pos"), F.lit(i).alias("list")))
    f = lists[0].unionByName(lists[1]).groupBy("doc_id").agg(F.min(F.struct("pos", "list")).alias("first"))
    return f.select("doc_id", F.row_number().over(Window.orderBy("first")).cast("long").alias("place"))  # forty rows at most


@query("""WITH r AS (SELECT doc_id, source, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
SELECT doc_id, least(n, 8000 - before)::BIGINT AS taken FROM r WHERE before < 8000""")
def text_budget(spark, sf):
    w = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    r = load(spark, sf, "documents").select("doc_id", "source", F.length("text").alias("n"))
    r = r.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return r.where("before < 8000").select("doc_id", F.least(F.col("n").cast("long"), 8000 - F.col("before")).alias("taken"))


@query("SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations")
def next_chunk_edges(spark, sf):
    return load(spark, sf, "conversations").select("conv_id", "turn", F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")).alias("next_turn"))


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE p_retailprice > 500 ORDER BY (p_size > 25) DESC, p_brand NULLS LAST, CASE p_type WHEN 'ECONOMY' THEN 1 ELSE 2 END, p_partkey LIMIT 50")
def sort_multi_key(spark, sf):
    p = load(spark, sf, "part").where("p_retailprice > 500")
    return p.orderBy((F.col("p_size") > 25).desc(), F.asc_nulls_last("p_brand"), F.when(F.col("p_type") == "ECONOMY", 1).otherwise(2), "p_partkey").limit(50).select("p_partkey", "p_brand", "p_size")


@query("SELECT doc_id, total_matches, total_matches > 20 AS truncated FROM (SELECT doc_id, n_chars, count(*) OVER () AS total_matches FROM documents WHERE lang = 'es') ORDER BY n_chars DESC, doc_id LIMIT 20")
def capped_page(spark, sf):
    d = load(spark, sf, "documents").where("lang = 'es'").select("doc_id", "n_chars")
    total = d.agg(F.count(F.lit(1)).alias("total_matches"))
    page = d.orderBy(F.desc("n_chars"), "doc_id").limit(20)
    return page.crossJoin(F.broadcast(total)).select("doc_id", "total_matches", (F.col("total_matches") > 20).alias("truncated"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id, count(*) FILTER (WHERE k <= 30) AS shown, count(*) FILTER (WHERE k > 30) AS hidden, round(coalesce(sum(value) FILTER (WHERE k > 30), 0), 4) AS hidden_value FROM r GROUP BY user_id""")
def recent_with_remainder(spark, sf):
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    r = load(spark, sf, "events").withColumn("k", k)
    return r.groupBy("user_id").agg(F.count_if(F.col("k") <= 30).alias("shown"), F.count_if(F.col("k") > 30).alias("hidden"), F.round(F.coalesce(F.sum(F.when(F.col("k") > 30, F.col("value"))), F.lit(0.0)), 4).alias("hidden_value"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey + 4 FROM supplier")
def union_distinct(spark, sf):
    return load(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(load(spark, sf, "supplier").select(F.col("s_nationkey") + 4)).distinct()


@query("""WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer), b AS (SELECT DISTINCT s_nationkey + 4 AS k FROM supplier)
SELECT 'missed' AS side, k FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'extra', k FROM (SELECT k FROM b EXCEPT SELECT k FROM a) UNION ALL SELECT 'both', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b)""")
def set_differences(spark, sf):
    a = load(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).distinct()
    b = load(spark, sf, "supplier").select((F.col("s_nationkey") + 4).alias("k")).distinct()
    tag = lambda df, s: df.select(F.lit(s).alias("side"), "k")
    return tag(a.subtract(b), "missed").unionByName(tag(b.subtract(a), "extra")).unionByName(tag(a.intersect(b), "both"))


@query("SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def distinct_tuples(spark, sf):
    return load(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus").distinct()
