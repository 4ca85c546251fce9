"""Coverage, gaps, runs, interpolation, steps and trends over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import intervals
from ..sources.tables import epoch_seconds, load
from .registry import query

T = "epoch_us(ts) / 1e6"
DAY = 86400.0


def _series(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select("event_id", "user_id", "event_type", "value", epoch_seconds("ts").alias("t"))


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    s = _series(spark, sf).withColumn("day", F.floor(F.col("t") / DAY).cast("long"))
    spans = s.select("event_type", "day", F.col("t").alias("a0"), (F.col("t") + 1200.0).alias("b0"))
    lo = F.col("day") * F.lit(DAY)
    return intervals.coverage(spans, ["event_type", "day"], "a0", "b0", lo, lo + DAY)


_DAILY_SQL = f"""
s AS (SELECT event_type, CAST(floor({T} / 86400.0) AS BIGINT) AS day, {T} AS a0, {T} + 1200.0 AS b0 FROM events),
c AS (SELECT event_type, day, greatest(a0, day * 86400.0) AS a, least(b0, day * 86400.0 + 86400.0) AS b FROM s),
w AS (SELECT *, greatest(coalesce(max(b) OVER (PARTITION BY event_type, day ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), day * 86400.0), day * 86400.0) AS cursor FROM c WHERE b > a),
daily AS (SELECT event_type, day, sum(greatest(0.0, b - greatest(a, cursor))) / 86400.0 AS coverage,
  greatest(max(greatest(0.0, a - cursor)), day * 86400.0 + 86400.0 - max(b)) / 60 AS longest_gap_min, max(b) AS last FROM w GROUP BY event_type, day)
"""


@query(f"WITH {_DAILY_SQL} SELECT event_type, day, round(coverage, 6) AS coverage, round(longest_gap_min, 4) AS longest_gap_min, round(last, 3) AS last, CASE WHEN coverage <= 0 THEN 'no_data' WHEN longest_gap_min > 90 THEN 'gaps' ELSE 'ok' END AS state FROM daily")
def span_coverage(spark, sf):
    d = _daily(spark, sf)
    return d.select("event_type", "day", F.round("coverage", 6).alias("coverage"), F.round("longest_gap_min", 4).alias("longest_gap_min"), F.round("last", 3).alias("last"), intervals.grade(F.col("coverage"), F.col("longest_gap_min"), 90).alias("state"))


@query(f"""WITH {_DAILY_SQL}, g AS (SELECT *, CASE WHEN coverage <= 0 THEN 2 WHEN longest_gap_min > 90 THEN 1 ELSE 0 END AS sev FROM daily)
SELECT day, max(sev)::BIGINT AS severity, arg_min(event_type, (-sev, event_type)) AS worst FROM g GROUP BY day""")
def worst_of_group(spark, sf):
    g = _daily(spark, sf).withColumn("sev", intervals.severity(intervals.grade(F.col("coverage"), F.col("longest_gap_min"), 90)))
    return g.groupBy("day").agg(F.max("sev").cast("long").alias("severity"), F.min_by("event_type", F.struct(-F.col("sev"), "event_type")).alias("worst"))


@query(f"""WITH {_DAILY_SQL}, g AS (SELECT *, CASE WHEN coverage <= 0 THEN 'no_data' WHEN longest_gap_min > 90 THEN 'gaps' ELSE 'ok' END AS state FROM daily)
, x AS (SELECT coalesce(p.day, q.day) AS day, p.state AS s1, coalesce(q.state, 'no_data') AS s2, coalesce(q.coverage, 0) AS c2, newest >= (coalesce(p.day, q.day) + 1) * 86400.0 AS passed
FROM (SELECT * FROM g WHERE event_type = 'click' AND day % 5 <> 0) p FULL OUTER JOIN (SELECT * FROM g WHERE event_type = 'view' AND day % 7 <> 0) q ON p.day = q.day, (SELECT max(last) AS newest FROM g WHERE event_type = 'view'))
SELECT day, CASE WHEN s1 IS NULL THEN s2 WHEN s1 = 'no_data' AND c2 > 0 THEN s2 WHEN s1 = 'ok' AND s2 = 'gaps' THEN 'gaps' WHEN s1 = 'ok' AND s2 = 'no_data' AND passed THEN 'gaps' ELSE s1 END AS state,
 CASE WHEN s1 IS NULL THEN NULL ELSE s1 = s2 OR (s2 = 'no_data' AND NOT passed) END AS agree FROM x""")
def two_witness_state(spark, sf):
    """Days that one of the witnesses did not report (every fifth, every seventh) show what a missing state does."""
    g = _daily(spark, sf).withColumn("state", intervals.grade(F.col("coverage"), F.col("longest_gap_min"), 90))
    p = g.where("event_type = 'click' AND day % 5 <> 0").select("day", F.col("state").alias("s1"))
    second = g.where("event_type = 'view'")
    q = second.where("day % 7 <> 0").select("day", F.col("state").alias("s2"), F.col("coverage").alias("c2"))
    newest = second.agg(F.max("last").alias("newest"))  # one row
    x = p.join(q, "day", "full_outer").crossJoin(F.broadcast(newest))
    state, agree = intervals.two_witnesses(F.col("s1"), F.col("s2"), F.col("c2"), F.col("newest") >= (F.col("day") + 1) * F.lit(DAY))
    return x.select("day", state.alias("state"), agree.alias("agree"))


@query(f"""WITH {_DAILY_SQL}, g AS (SELECT *, CASE WHEN coverage <= 0 THEN 'no_data' WHEN longest_gap_min > 90 THEN 'gaps' ELSE 'ok' END AS state FROM daily),
r AS (SELECT *, bool_or(event_type = 'error' AND state <> 'ok') OVER (PARTITION BY day) AS shared FROM g)
SELECT event_type, day, CASE WHEN shared AND event_type <> 'error' AND state IN ('no_data', 'gaps') THEN 'diverted' ELSE state END AS state FROM r""")
def cross_row_rule(spark, sf):
    g = _daily(spark, sf).withColumn("state", intervals.grade(F.col("coverage"), F.col("longest_gap_min"), 90))
    shared = F.bool_or((F.col("event_type") == "error") & (F.col("state") != "ok")).over(Window.partitionBy("day"))
    return g.withColumn("shared", shared).select(
        "event_type", "day", F.when(F.col("shared") & (F.col("event_type") != "error") & F.col("state").isin("no_data", "gaps"), "diverted").otherwise(F.col("state")).alias("state")
    )


@query(f"""WITH {_DAILY_SQL}, g AS (SELECT *, CASE WHEN coverage <= 0 THEN 'no_data' WHEN longest_gap_min > 90 THEN 'gaps' ELSE 'ok' END AS state FROM daily),
l AS (SELECT *, lag(state) OVER (PARTITION BY event_type ORDER BY day) AS before FROM g),
r AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> state THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY day ROWS UNBOUNDED PRECEDING) AS run FROM l)
SELECT event_type, day, state, min(day) OVER (PARTITION BY event_type, run) AS since FROM r""")
def state_since(spark, sf):
    g = _daily(spark, sf).withColumn("state", intervals.grade(F.col("coverage"), F.col("longest_gap_min"), 90))
    w = Window.partitionBy("event_type").orderBy("day")
    r = intervals.runs(g.withColumn("before", F.lag("state").over(w)), ["event_type"], ["day"], F.col("before").isNull() | (F.col("before") != F.col("state")))
    return r.select("event_type", "day", "state", F.min("day").over(Window.partitionBy("event_type", "run")).alias("since"))


@query(f"""WITH {_DAILY_SQL}, n AS (SELECT max({T}) AS now FROM events), k AS (SELECT event_type, max(last) AS last, arg_max(CASE WHEN longest_gap_min > 90 THEN 'gaps' ELSE 'ok' END, day) AS stored FROM daily GROUP BY event_type)
SELECT event_type, stored, CASE WHEN (now - last) / 60 > 1440 THEN 'no_data' WHEN stored = 'no_data' THEN 'ok' ELSE stored END AS live FROM k, n""")
def live_override(spark, sf):
    now = _series(spark, sf).agg(F.max("t").alias("now"))
    k = _daily(spark, sf).groupBy("event_type").agg(F.max("last").alias("last"), F.max_by(F.when(F.col("longest_gap_min") > 90, "gaps").otherwise("ok"), "day").alias("stored"))
    return k.crossJoin(F.broadcast(now)).select(
        "event_type", "stored", F.when((F.col("now") - F.col("last")) / 60 > 1440, "no_data").when(F.col("stored") == "no_data", "ok").otherwise(F.col("stored")).alias("live")
    )


@query(f"""WITH h AS (SELECT event_type, CAST(floor({T} / 3600.0) AS BIGINT) AS hour, avg(value) > 50 AS bad FROM events GROUP BY ALL),
l AS (SELECT *, lag(bad) OVER (PARTITION BY event_type ORDER BY hour) AS p FROM h),
r AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> bad THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY hour ROWS UNBOUNDED PRECEDING) AS run FROM l),
z AS (SELECT event_type, run, count(*) AS n FROM r WHERE bad GROUP BY ALL)
SELECT event_type, max(n) AS longest_bad_hours FROM z GROUP BY event_type""")
def longest_bad_run(spark, sf):
    h = _series(spark, sf).groupBy("event_type", F.floor(F.col("t") / 3600.0).alias("hour")).agg((F.avg("value") > 50).alias("bad"))
    w = Window.partitionBy("event_type").orderBy("hour")
    r = intervals.runs(h.withColumn("p", F.lag("bad").over(w)), ["event_type"], ["hour"], F.col("p").isNull() | (F.col("p") != F.col("bad")))
    return r.where("bad").groupBy("event_type", "run").agg(F.count(F.lit(1)).alias("n")).groupBy("event_type").agg(F.max("n").alias("longest_bad_hours"))


@query(f"""WITH s AS (SELECT user_id, {T} AS t FROM events), d AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS d FROM s),
c AS (SELECT user_id, quantile_cont(d, 0.9) AS p90 FROM d WHERE d > 0 GROUP BY user_id),
y AS (SELECT d.user_id, quantile_cont(d, 0.5) AS period FROM d JOIN c USING (user_id) WHERE d > 0 AND d <= p90 GROUP BY d.user_id),
e AS (SELECT user_id, count(*) AS n, max(t) - min(t) AS duration FROM s GROUP BY user_id),
z AS (SELECT e.user_id, n, period, round_even(duration / period, 0) + 1 AS expected FROM e JOIN y USING (user_id)),
f AS (SELECT *, abs(n - expected) <= greatest(5.0, floor(expected * 0.001)) AS "full" FROM z),
h AS (SELECT *, period * CASE WHEN period >= 10 THEN CASE WHEN "full" THEN 4.0 ELSE 3.0 END WHEN period >= 0.5 THEN CASE WHEN "full" THEN 3.5 ELSE 2.5 END ELSE CASE WHEN "full" THEN 2.5 ELSE 2.0 END END AS threshold FROM f)
SELECT h.user_id, any_value(n) AS n, round(any_value(period), 3) AS period, any_value(expected) AS expected, any_value("full") AS is_full, round(any_value(threshold), 3) AS threshold,
 count(*) FILTER (WHERE d > threshold) AS n_gaps, coalesce(sum(CASE WHEN d > threshold THEN round_even(d / period, 0) - 1 END), 0.0) AS missing
FROM d JOIN h USING (user_id) GROUP BY h.user_id""")
def gap_detector_period(spark, sf):
    g = intervals.gaps_by_period(_series(spark, sf).select("user_id", "t"), ["user_id"], "t")
    return g.select("user_id", "n", F.round("period", 3).alias("period"), "expected", F.col("full").alias("is_full"), F.round("threshold", 3).alias("threshold"), "n_gaps", "missing")


@query(f"""WITH s AS (SELECT user_id, {T} AS t FROM events), d AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS d FROM s),
g AS (SELECT user_id, quantile_cont(d, 0.5) AS guess FROM d WHERE d IS NOT NULL GROUP BY user_id),
p AS (SELECT d.*, guess, round_even(d / guess, 0) AS step FROM d JOIN g USING (user_id) WHERE guess > 0),
x AS (SELECT *, coalesce(sum(step) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING), 0.0) AS number, min(t) OVER (PARTITION BY user_id) AS first FROM p),
f AS (SELECT user_id, regr_slope(t - first, number) AS period, max(number) + 1 AS ideal, count(*) AS n, count(*) FILTER (WHERE step > 1) AS raw FROM x GROUP BY user_id)
SELECT x.user_id, any_value(n) AS n, round(any_value(period), 3) AS period, any_value(ideal) AS ideal, greatest(0.0, any_value(ideal) - any_value(n)) AS true_missing,
 CASE WHEN any_value(ideal) - any_value(n) > 0 THEN any_value(raw) ELSE 0 END AS n_gaps, round(max(abs((t - first - number * period) / period)), 3) AS worst, round(stddev_pop(t - first - number * period), 2) AS sigma_s
FROM x JOIN f USING (user_id) WHERE period > 0 GROUP BY x.user_id""")
def gap_detector_fit(spark, sf):
    g = intervals.gaps_by_fit(_series(spark, sf).select("user_id", "t"), ["user_id"], "t")
    return g.select("user_id", "n", F.round("period", 3).alias("period"), "ideal", "true_missing", F.col("n_gaps").cast("long").alias("n_gaps"), F.round("worst", 3).alias("worst"), F.round(F.col("sigma_ms") / 1000, 2).alias("sigma_s"))


@query(f"""WITH b AS (SELECT floor(min({T}) / 86400.0) * 86400.0 AS lo, ceil(max({T}) / 86400.0) * 86400.0 AS hi FROM events),
s AS (SELECT user_id, {T} AS a, {T} + 7200.0 AS e FROM events), c AS (SELECT user_id, greatest(a, lo) AS a, least(e, hi) AS e, lo, hi FROM s, b),
o AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY a, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM c WHERE e > a),
r AS (SELECT *, sum(CASE WHEN reached IS NULL OR a > reached THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, e ROWS UNBOUNDED PRECEDING) AS run FROM o),
m AS (SELECT user_id, min(a) AS a, max(e) AS e, any_value(lo) AS lo, any_value(hi) AS hi FROM r GROUP BY user_id, run),
f AS (SELECT user_id, e AS x, coalesce(lead(a) OVER (PARTITION BY user_id ORDER BY a), hi) AS y FROM m UNION ALL SELECT user_id, any_value(lo), min(a) FROM m GROUP BY user_id)
SELECT user_id, count(*) AS n, round(sum(y - x), 2) AS free_seconds, round(max(y - x), 2) AS longest FROM f WHERE y > x GROUP BY user_id""")
def stable_intervals(spark, sf):
    s = _series(spark, sf)
    b = s.agg((F.floor(F.min("t") / DAY) * DAY).alias("lo"), (F.ceil(F.max("t") / DAY) * DAY).alias("hi")).first()
    spans = s.select("user_id", F.col("t").alias("a"), (F.col("t") + 7200.0).alias("e"))
    free = intervals.complement(spans, ["user_id"], "a", "e", F.lit(b["lo"]), F.lit(b["hi"]))
    length = F.col("free_to") - F.col("free_from")
    return free.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(length), 2).alias("free_seconds"), F.round(F.max(length), 2).alias("longest"))


@query(f"""WITH a AS (SELECT event_type, CAST(floor({T} / 86400.0) AS BIGINT) * 86400.0 AS t, avg(value) AS v FROM events GROUP BY ALL),
k AS (SELECT DISTINCT event_type FROM a), r AS (SELECT min(t) - 21600 AS lo, max(t) + 21600 AS hi FROM a),
q AS (SELECT event_type, unnest(generate_series(lo::BIGINT, hi::BIGINT, 21600))::DOUBLE AS t FROM k, r),
u AS (SELECT event_type, t, v, t AS at_, false AS asked FROM a UNION ALL SELECT event_type, t, NULL, NULL, true FROM q),
w AS (SELECT event_type, t, asked, last_value(v IGNORE NULLS) OVER b AS v0, last_value(at_ IGNORE NULLS) OVER b AS t0, first_value(v IGNORE NULLS) OVER f AS v1, first_value(at_ IGNORE NULLS) OVER f AS t1 FROM u
 WINDOW b AS (PARTITION BY event_type ORDER BY t, asked ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY event_type ORDER BY t, asked ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_type, t, round(1e-9 + CASE WHEN t0 = t THEN v0 ELSE v0 + (v1 - v0) / (t1 - t0) * (t - t0) END, 6) AS v, round(1e-6 + t - coalesce(CASE WHEN t0 = t THEN v0 ELSE v0 + (v1 - v0) / (t1 - t0) * (t - t0) END, 0), 2) AS corrected FROM w WHERE asked""")
def interpolate_clock(spark, sf):
    a = _series(spark, sf).groupBy("event_type", (F.floor(F.col("t") / DAY) * DAY).alias("t")).agg(F.avg("value").alias("v"))
    r = a.agg((F.min("t") - 21600).cast("long").alias("lo"), (F.max("t") + 21600).cast("long").alias("hi"))
    q = a.select("event_type").distinct().crossJoin(F.broadcast(r)).select("event_type", F.explode(F.sequence("lo", "hi", F.lit(21600))).alias("s")).select("event_type", F.col("s").cast("double").alias("t"))
    i = intervals.interpolate(a, q, ["event_type"], "t", "v")
    # The tiny shift keeps exact ties of the sixth digit on one side in any engine.
    return i.select("event_type", "t", F.round(F.col("v") + 1e-9, 6).alias("v"), F.round(F.col("t") - F.coalesce("v", F.lit(0.0)) + 1e-6, 2).alias("corrected"))


@query(f"""WITH d AS (SELECT user_id, {T} AS t, {T} - lag({T}) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events),
r AS (SELECT *, sum(CASE WHEN d IS NULL OR d > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM d)
SELECT user_id, session, count(*) AS n, round(max(t) - min(t), 3) AS seconds FROM r GROUP BY ALL""")
def sessions_by_gap(spark, sf):
    w = Window.partitionBy("user_id").orderBy("t")
    d = _series(spark, sf).withColumn("d", F.col("t") - F.lag("t").over(w))
    r = intervals.runs(d, ["user_id"], ["t"], F.col("d").isNull() | (F.col("d") > 1800), "session")
    return r.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("t") - F.min("t"), 3).alias("seconds"))


_CALENDAR = f"""e AS (SELECT user_id, CAST(floor({T} / 86400.0) AS BIGINT) AS day FROM events), b AS (SELECT min(day) AS lo, max(day) AS hi FROM e),
cal AS (SELECT user_id, unnest(generate_series(lo, hi)) AS day FROM (SELECT DISTINCT user_id FROM e), b),
n AS (SELECT cal.user_id, cal.day, count(e.day) AS n FROM cal LEFT JOIN e ON cal.user_id = e.user_id AND cal.day = e.day GROUP BY ALL)"""


def _calendar(spark, sf) -> DataFrame:
    e = _series(spark, sf).select("user_id", F.floor(F.col("t") / DAY).alias("day")).groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"))
    b = e.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    cal = e.select("user_id").distinct().crossJoin(F.broadcast(b)).select("user_id", F.explode(F.sequence("lo", "hi")).alias("day"))
    return cal.join(e, ["user_id", "day"], "left").select("user_id", "day", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {_CALENDAR}, l AS (SELECT *, lag(n = 0) OVER (PARTITION BY user_id ORDER BY day) AS p FROM n),
r AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> (n = 0) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS run FROM l)
SELECT user_id, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM r WHERE n = 0 GROUP BY user_id, run HAVING count(*) >= 2""")
def empty_day_runs(spark, sf):
    c = _calendar(spark, sf).withColumn("empty", F.col("n") == 0)
    c = c.withColumn("p", F.lag("empty").over(Window.partitionBy("user_id").orderBy("day")))
    r = intervals.runs(c, ["user_id"], ["day"], F.col("p").isNull() | (F.col("p") != F.col("empty")))
    return r.where("empty").groupBy("user_id", "run").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("days")).where("days >= 2").drop("run")


@query(f"""WITH {_CALENDAR} SELECT user_id, round(100.0 * count(*) FILTER (WHERE n > 0) / count(*), 6) AS percent, count(*) FILTER (WHERE n = 0) AS missing_days, 100.0 * count(*) FILTER (WHERE n > 0) / count(*) >= 99.99 AS is_full FROM n GROUP BY user_id""")
def availability(spark, sf):
    share = 100.0 * F.count_if(F.col("n") > 0) / F.count(F.lit(1))
    return _calendar(spark, sf).groupBy("user_id").agg(F.round(share, 6).alias("percent"), F.count_if(F.col("n") == 0).alias("missing_days"), (share >= 99.99).alias("is_full"))


@query(f"""WITH s AS (SELECT event_type, {T} AS t, floor(value / 40) AS v FROM events), l AS (SELECT *, lag(v) OVER (PARTITION BY event_type ORDER BY t) AS p FROM s),
r AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> v THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY t ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM l)
SELECT event_type, run, any_value(v)::BIGINT AS v, count(*) AS n FROM r GROUP BY event_type, run HAVING count(*) >= 5""")
def stuck_values(spark, sf):
    s = _series(spark, sf).select("event_type", "t", F.floor(F.col("value") / 40).alias("v"))
    s = s.withColumn("p", F.lag("v").over(Window.partitionBy("event_type").orderBy("t")))
    r = intervals.runs(s, ["event_type"], ["t"], F.col("p").isNull() | (F.col("p") != F.col("v")))
    return r.groupBy("event_type", "run").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("n")).where("n >= 5")


@query(f"""WITH s AS (SELECT event_type, {T} AS t, value FROM events), l AS (SELECT *, value - lag(value) OVER o AS jump, t - lag(t) OVER o AS dt FROM s WINDOW o AS (PARTITION BY event_type ORDER BY t)),
j AS (SELECT event_type, t, jump FROM l WHERE abs(jump) > 150 AND dt <= 3600), g AS (SELECT *, t - lag(t) OVER (PARTITION BY event_type ORDER BY t) AS since FROM j),
r AS (SELECT *, sum(CASE WHEN since IS NULL OR since > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY t ROWS UNBOUNDED PRECEDING) AS grp FROM g),
k AS (SELECT event_type, grp, min(t) AS t0, max(t) AS t1, count(*) AS n FROM r GROUP BY event_type, grp)
SELECT k.event_type, round(t0, 3) AS t0, any_value(n) AS n, round(quantile_cont(value, 0.5) FILTER (WHERE s.t < t0), 4) AS before, round(quantile_cont(value, 0.5) FILTER (WHERE s.t > t1), 4) AS after,
 coalesce(abs(quantile_cont(value, 0.5) FILTER (WHERE s.t > t1) - quantile_cont(value, 0.5) FILTER (WHERE s.t < t0)) > 20, false) AS is_step
FROM k JOIN s ON s.event_type = k.event_type AND s.t BETWEEN t0 - 3600 AND t1 + 3600 GROUP BY k.event_type, t0, t1""")
def step_detection(spark, sf):
    s = _series(spark, sf).select("event_type", "t", "value")
    w = Window.partitionBy("event_type").orderBy("t")
    j = s.select("event_type", "t", (F.col("value") - F.lag("value").over(w)).alias("jump"), (F.col("t") - F.lag("t").over(w)).alias("dt")).where("abs(jump) > 150 AND dt <= 3600")
    j = j.withColumn("since", F.col("t") - F.lag("t").over(w))
    k = intervals.runs(j, ["event_type"], ["t"], F.col("since").isNull() | (F.col("since") > 1800), "grp").groupBy("event_type", "grp").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count(F.lit(1)).alias("n"))
    # Range join on whole hours: a group looks at the hours it touches, one before and one after.
    k = k.withColumn("hour", F.explode(F.sequence(F.floor((F.col("t0") - 3600) / 3600), F.floor((F.col("t1") + 3600) / 3600))))
    near = s.withColumn("hour", F.floor(F.col("t") / 3600)).join(k, ["event_type", "hour"]).where("t BETWEEN t0 - 3600 AND t1 + 3600")
    before = F.percentile(F.when(F.col("t") < F.col("t0"), F.col("value")), 0.5)
    after = F.percentile(F.when(F.col("t") > F.col("t1"), F.col("value")), 0.5)
    return near.groupBy("event_type", "t0", "t1").agg(
        F.first("n").alias("n"), F.round(before, 4).alias("before"), F.round(after, 4).alias("after"), F.coalesce(F.abs(after - before) > 20, F.lit(False)).alias("is_step")
    ).select("event_type", F.round("t0", 3).alias("t0"), "n", "before", "after", "is_step")


@query(f"""WITH l AS (SELECT user_id, {T} AS t, {T} - lag({T}) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events),
r AS (SELECT user_id, t, max(CASE WHEN d IS NULL OR d > 7200 THEN t END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS restart FROM l)
SELECT user_id, count(*) AS n, count(*) FILTER (WHERE t - restart >= 1800) AS kept FROM r GROUP BY user_id""")
def warmup_suppression(spark, sf):
    w = Window.partitionBy("user_id").orderBy("t")
    l = _series(spark, sf).select("user_id", "t").withColumn("d", F.col("t") - F.lag("t").over(w))
    r = l.withColumn("restart", F.max(F.when(F.col("d").isNull() | (F.col("d") > 7200), F.col("t"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("t") - F.col("restart") >= 1800).alias("kept"))


@query(f"""WITH m AS (SELECT event_type, {T} AS t, value, quantile_cont(value, 0.5) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS med FROM events),
d AS (SELECT event_type, quantile_cont(abs(value - med), 0.5) AS mad FROM m GROUP BY event_type)
SELECT event_type, count(*) AS n, count(*) FILTER (WHERE abs(value - med) > 6 * 1.4826 * mad) AS spikes FROM m JOIN d USING (event_type) GROUP BY event_type""")
def spike_removal(spark, sf):
    w = Window.partitionBy("event_type").orderBy("t").rowsBetween(-7, 7)
    m = _series(spark, sf).select("event_type", "value", F.percentile("value", 0.5).over(w).alias("med"))
    d = m.groupBy("event_type").agg(F.percentile(F.abs(F.col("value") - F.col("med")), 0.5).alias("mad"))
    return m.join(F.broadcast(d), "event_type").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("value") - F.col("med")) > 6 * 1.4826 * F.col("mad")).alias("spikes"))


@query(f"""WITH d AS (SELECT event_type, CAST(floor({T} / 86400.0) AS BIGINT) AS day, avg(value) AS v FROM events GROUP BY ALL)
SELECT a.event_type, a.day, count(*) AS n, CASE WHEN count(*) >= 7 THEN round(regr_slope(b.v, b.day - a.day) * 365.25, 4) END AS per_year
FROM d a JOIN d b ON a.event_type = b.event_type AND b.day BETWEEN a.day - 13 AND a.day GROUP BY a.event_type, a.day""")
def window_trend(spark, sf):
    d = _series(spark, sf).groupBy("event_type", F.floor(F.col("t") / DAY).alias("day")).agg(F.avg("value").alias("v"))
    w = Window.partitionBy("event_type").orderBy("day").rangeBetween(-13, 0)
    n = F.count(F.lit(1)).over(w)
    x = d.withColumn("x", F.col("day").cast("double"))
    return x.select("event_type", "day", n.alias("n"), F.when(n >= 7, F.round(F.regr_slope("v", "x").over(w) * 365.25, 4)).alias("per_year"))


@query(f"""WITH s AS (SELECT event_type, {T} AS t, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events),
b AS (SELECT *, CASE WHEN n <= 200 THEN rn ELSE floor(rn / ceil(n / 100.0)) END AS bucket FROM s),
x AS (SELECT event_type, bucket, min((v, t)) AS lo, max((v, -t)) AS hi FROM b GROUP BY ALL)
SELECT event_type, round(t, 3) AS t, v FROM (SELECT event_type, lo[2] AS t, lo[1] AS v FROM x UNION SELECT event_type, -hi[2], hi[1] FROM x)""")
def decimate_minmax(spark, sf):
    s = _series(spark, sf).select("event_type", "t", F.col("value").alias("v"))
    return intervals.decimate(s, ["event_type"], "t", "v", 200).select("event_type", F.round("t", 3).alias("t"), "v")
