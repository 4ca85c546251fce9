"""Steps, stitching, live states and the fitting gap detector over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import steps
from ..sources.tables import epoch_seconds, load
from .registry import query

T = "(epoch_us(ts) / 1e6)"
JUMP, GAP_JUMP = 120.0, 60.0

_STEPS = f"""s AS (SELECT event_id, event_type || '-' || user_id % 3 AS k, {T} AS t, CASE WHEN event_id % 17 <> 0 THEN value END AS x, value / 2 - 20 AS y FROM events), ok AS (SELECT * FROM s WHERE x IS NOT NULL),
l AS (SELECT *, lag(t) OVER w AS pt, greatest(abs(x - lag(x) OVER w), abs(y - lag(y) OVER w)) AS change FROM ok WINDOW w AS (PARTITION BY k ORDER BY t)), m AS (SELECT *, t - pt > 3600 AND change > {GAP_JUMP} AS gap FROM l WHERE (change > {JUMP} AND t - pt <= 3600) OR (t - pt > 3600 AND change > {GAP_JUMP})),
o AS (SELECT *, sum(CASE WHEN gap OR lag_t IS NULL OR t - lag_t > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY t) AS step FROM (SELECT *, lag(t) OVER (PARTITION BY k ORDER BY t) AS lag_t FROM m)),
g AS (SELECT k, step, min(pt) AS a, max(t) AS e FROM o GROUP BY k, step), z AS (SELECT g.*, quantile_cont(x, 0.5) FILTER (WHERE t > a - 3600 AND t <= a) AS xb, quantile_cont(y, 0.5) FILTER (WHERE t > a - 3600 AND t <= a) AS yb, quantile_cont(x, 0.5) FILTER (WHERE t >= e AND t < e + 3600) AS xa,
quantile_cont(y, 0.5) FILTER (WHERE t >= e AND t < e + 3600) AS ya FROM g JOIN ok ON ok.k = g.k AND t > a - 3600 AND t < e + 3600 GROUP BY ALL),
st AS (SELECT k, a, e, CASE WHEN greatest(abs(xa), abs(ya)) < 25 AND greatest(abs(xa - xb), abs(ya - yb)) > 50 THEN 'relevel' WHEN (e - a) / 3600 > 1 THEN 'across gap' ELSE 'step' END AS kind, xa - xb AS dx, ya - yb AS dy FROM z WHERE greatest(abs(xa - xb), abs(ya - yb)) >= {JUMP})"""


def _samples(spark, sf):
    e = load(spark, sf, "events")
    return e.select("event_id", F.concat("event_type", F.lit("-"), F.col("user_id") % 3).alias("k"), epoch_seconds("ts").alias("t"), F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("x"), (F.col("value") / 2 - 20).alias("y"))


@query(f"WITH {_STEPS} SELECT k, round(a, 3) AS started, round(e, 3) AS ended, kind, round(dx, 4) AS dx, round(dy, 4) AS dy FROM st")
def step_kinds(spark, sf):
    s = steps.detect_steps(_samples(spark, sf), ["k"], JUMP, GAP_JUMP)
    return s.select("k", F.round("start", 3).alias("started"), F.round("end", 3).alias("ended"), "kind", F.round("dx", 4).alias("dx"), F.round("dy", 4).alias("dy"))


@query(f"""WITH {_STEPS}, r AS (SELECT * FROM st WHERE kind IN ('relevel', 'step')), c AS (SELECT s.event_id, any_value(x) AS x, any_value(y) AS y, coalesce(sum(dx) FILTER (WHERE e <= t), 0) AS ox, coalesce(sum(dy) FILTER (WHERE e <= t), 0) AS oy, coalesce(bool_or(a < t AND t < e), false) AS inside
FROM s LEFT JOIN r ON r.k = s.k GROUP BY s.event_id) SELECT event_id, round(CASE WHEN NOT inside THEN x - ox END, 4) AS x, round(CASE WHEN NOT inside THEN y - oy END, 4) AS y FROM c""")
def stitched_series(spark, sf):
    s = _samples(spark, sf)
    out = steps.stitched(s, steps.detect_steps(s, ["k"], JUMP, GAP_JUMP), ["k"], ["relevel", "step"])
    return out.select("event_id", F.round("x_stitched", 4).alias("x"), F.round("y_stitched", 4).alias("y"))


_ROWS = """o_orderkey AS sensor, CASE o_orderkey % 5 WHEN 0 THEN 'no_data' WHEN 1 THEN 'gaps' WHEN 2 THEN 'diverted' ELSE 'ok' END AS state, CASE WHEN o_orderkey % 5 < 2 THEN '2024-05-20' END AS since,
CASE WHEN o_orderkey % 3 <> 0 THEN 1717286400 - o_custkey * 173 % 400000 END AS last, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey % 300 END AS gap, CASE WHEN o_orderkey % 2 = 0 THEN 'Checker one' ELSE 'Other' END AS source, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 11 <> 0 END AS agree"""
_LIVE = """o_orderkey AS sensor, CASE o_orderkey % 7 WHEN 0 THEN 'GOOD' WHEN 1 THEN 'WARN' WHEN 2 THEN 'UNMONITORED' WHEN 3 THEN NULL ELSE 'BAD' END AS verdict, CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey % 4000 END AS delay"""


@query(f"""WITH r AS (SELECT {_ROWS}, {_LIVE.replace('o_orderkey AS sensor, ', '')}, o_orderkey % 17 = 0 AS unheard FROM orders), q AS (SELECT *, CASE WHEN unheard THEN NULL ELSE verdict END AS v, coalesce(last, CASE WHEN NOT unheard THEN 1717286400 - delay * 60 END) AS s0 FROM r),
p AS (SELECT *, CASE WHEN s0 IS NOT NULL AND state <> 'no_data' THEN greatest(s0, 1717113600) ELSE s0 END AS s FROM q), k AS (SELECT *, CASE WHEN v IS NULL OR v = 'UNMONITORED' OR state = 'diverted' THEN 'base' WHEN v = 'BAD' THEN CASE WHEN s IS NULL OR 1717286400 - s >= 86400 THEN 'no_data' WHEN (1717286400 - s) / 60.0 > coalesce(gap, 60) THEN 'gaps' ELSE 'base' END
WHEN state IN ('no_data', 'gaps') AND source LIKE 'Checker%' AND coalesce(agree, true) THEN 'ok' ELSE 'base' END AS c FROM p)
SELECT sensor, CASE c WHEN 'base' THEN state ELSE c END AS state, CASE c WHEN 'base' THEN since WHEN 'no_data' THEN CASE WHEN state = 'no_data' THEN since ELSE coalesce(strftime(to_timestamp(s) AT TIME ZONE 'UTC', '%Y-%m-%d'), since) END WHEN 'gaps' THEN strftime(to_timestamp(s) AT TIME ZONE 'UTC', '%Y-%m-%d') END AS since, c <> 'base' AS live, CASE WHEN c <> 'base' THEN state END AS daily_state FROM k""")
def live_states(spark, sf):
    o = load(spark, sf, "orders")
    cut = lambda text: text.replace("\n", " ").split(", CASE")
    expressions = lambda text: [p if i == 0 else f"CASE{p}" for i, p in enumerate(cut(text))]
    live = o.where("o_orderkey % 17 <> 0").selectExpr(*expressions(_LIVE))
    return steps.live_states(o.selectExpr(*expressions(_ROWS)), live, 1717286400.0, 1717113600.0, "Checker")


_KEY = "CASE WHEN user_id % 3 = 0 THEN user_id % 9 ELSE user_id + 1000 END"


@query(f"""WITH s AS (SELECT {_KEY} AS k, {T} AS t FROM events), c AS (SELECT k, count(*) AS n FROM s GROUP BY k), d AS (SELECT k, n, t, t - lag(t) OVER (PARTITION BY k ORDER BY t) AS d, min(t) OVER (PARTITION BY k) AS first FROM s JOIN c USING (k)),
g AS (SELECT k, quantile_cont(d, 0.5) AS guess FROM d WHERE n >= 100 GROUP BY k), x AS (SELECT d.*, coalesce(sum(round_even(d.d / guess, 0)) OVER (PARTITION BY k ORDER BY t), 0.0) AS number, round_even(d.d / guess, 0) AS step FROM d JOIN g USING (k)),
f AS (SELECT k, regr_slope(t - first, number) AS period, max(number) + 1 AS ideal, count(*) FILTER (WHERE step > 1) AS raw FROM x GROUP BY k), w AS (SELECT k, max(abs((t - first - number * period) / period)) AS worst FROM x JOIN f USING (k) GROUP BY k),
p AS (SELECT k, quantile_cont(d, 0.9) AS p90 FROM d WHERE n < 100 AND d > 0 GROUP BY k), y AS (SELECT k, quantile_cont(d, 0.5) AS period FROM d JOIN p USING (k) WHERE d > 0 AND d <= p90 GROUP BY k), e AS (SELECT k, period, n, round_even((max(t) - min(t)) / period, 0) + 1 AS expected FROM d JOIN y USING (k) GROUP BY k, period, n),
h AS (SELECT k, period, n, period * CASE WHEN period >= 10 THEN 3.0 WHEN period >= 0.5 THEN 2.5 ELSE 2.0 END + CASE WHEN abs(n - expected) <= greatest(5.0, floor(expected * 0.001)) THEN period * CASE WHEN period >= 0.5 THEN 1.0 ELSE 0.5 END ELSE 0 END AS threshold FROM e)
SELECT k, 'fit' AS method, n, round(period, 3) AS period, CASE WHEN ideal > n THEN raw ELSE 0 END AS n_gaps, greatest(0.0, ideal - n) AS missing, worst > 0.4 AS unstable FROM f JOIN w USING (k) JOIN c USING (k) WHERE period > 0
UNION ALL SELECT h.k, 'step', any_value(h.n), round(any_value(period), 3), count(*) FILTER (WHERE d > threshold), coalesce(sum(CASE WHEN d > threshold THEN round_even(d / period, 0) - 1 END), 0.0), NULL FROM h JOIN d ON d.k = h.k GROUP BY h.k""")
def gap_detector(spark, sf):
    e = load(spark, sf, "events").select(F.expr(_KEY).alias("k"), epoch_seconds("ts").alias("t"))
    return steps.detect_gaps(e, ["k"], "t").select("k", "method", "n", F.round("period", 3).alias("period"), "n_gaps", "missing", "unstable")
