"""Filters and fits over the events as series of samples; the SQL runs each recursion sample by sample."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import signals
from ..sources.tables import epoch_seconds, load
from .registry import query

RATE, LOW, HIGH = 20.0, 1.0, 3.0
_SECTIONS = signals.butterworth(4, LOW, HIGH, RATE)
_PAD = 3 * (2 * len(_SECTIONS) + 1)
_SERIES = "s AS (SELECT event_type || '-' || user_id % 4 AS series, event_id, value AS x, row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY ts, event_id) - 1 AS n FROM events)"


def samples(spark, sf):
    """series, n, x and event_id: 20 series in order of time."""
    e = load(spark, sf, "events")
    order = Window.partitionBy("event_type", F.col("user_id") % 4).orderBy("ts", "event_id")
    return e.select(F.concat("event_type", F.lit("-"), F.col("user_id") % 4).alias("series"), (F.row_number().over(order) - 1).cast("long").alias("n"), F.col("value").alias("x"), "event_id", "ts")


def _settled() -> list[tuple[float, float]]:
    """The sections' states under a constant input of one."""
    out, u = [], 1.0
    for b0, b1, b2, a1, a2 in _SECTIONS.tolist():
        y = u * (b0 + b1 + b2) / (1 + a1 + a2)
        out.append((b1 * u - a1 * y + b2 * u - a2 * y, b2 * u - a2 * y))
        u = y
    return out


def _recursion(name: str, source: str) -> str:
    """One pass of all sections over ``source`` (series, k, x), sample by sample."""
    states = ", ".join(f"{p!r} * x AS s{i}1, {q!r} * x AS s{i}2" for i, (p, q) in enumerate(_settled(), 1))
    inner = f"SELECT r.*, e.x AS u0, e.k AS k1 FROM {name} r JOIN {source} e ON e.series = r.series AND e.k = r.k + 1"
    for i, (b0, *_) in enumerate(_SECTIONS.tolist(), 1):
        inner = f"SELECT *, {b0!r} * u{i - 1} + s{i}1 AS u{i} FROM ({inner})"
    moved = ", ".join(f"{b1!r} * u{i - 1} - ({a1!r}) * u{i} + s{i}2, {b2!r} * u{i - 1} - ({a2!r}) * u{i}" for i, (_, b1, b2, a1, a2) in enumerate(_SECTIONS.tolist(), 1))
    return f"{name} AS (SELECT series, -1::BIGINT AS k, 0.0::DOUBLE AS y, {states} FROM {source} WHERE k = 0 UNION ALL SELECT series, k1, u{len(_SECTIONS)}, {moved} FROM ({inner}))"


@query(f"""WITH RECURSIVE {_SERIES}, m AS (SELECT series, count(*) AS size, avg(x) AS mean FROM s GROUP BY series HAVING count(*) > {_PAD}), a AS (SELECT series, n, size, greatest(1, floor(size * 0.05))::BIGINT AS t, least(n, size - 1 - n) AS near, x - mean AS x FROM s JOIN m USING (series)),
w AS (SELECT series, n, size, x * CASE WHEN near < t THEN 0.5 * (1 - cos(CASE WHEN t > 1 THEN near * pi() / (t - 1) ELSE 0 END)) ELSE 1 END AS x FROM a),
e AS (SELECT series, n + {_PAD} AS k, x FROM w UNION ALL SELECT w.series, {_PAD} - w.n, 2 * h.x - w.x FROM w JOIN w h ON h.series = w.series AND h.n = 0 WHERE w.n BETWEEN 1 AND {_PAD}
UNION ALL SELECT w.series, 2 * (w.size - 1) - w.n + {_PAD}, 2 * h.x - w.x FROM w JOIN w h ON h.series = w.series AND h.n = w.size - 1 WHERE w.n BETWEEN w.size - 1 - {_PAD} AND w.size - 2),
{_recursion("f", "e")}, g AS (SELECT f.series, size + {2 * _PAD} - 1 - k AS k, y AS x FROM f JOIN m USING (series) WHERE k >= 0), {_recursion("b", "g")},
z AS (SELECT b.series, size + {2 * _PAD} - 1 - k - {_PAD} AS n, y FROM b JOIN m USING (series) WHERE k >= 0) SELECT event_id, round(y, 7) AS filtered FROM z JOIN s USING (series, n)""")
def bandpass_filter(spark, sf):
    s = samples(spark, sf)
    found = signals.bandpass(s, RATE, LOW, HIGH)
    return s.join(found.withColumnRenamed("x", "y"), ["series", "n"]).select("event_id", F.round("y", 7).alias("filtered"))


@query(f"""WITH RECURSIVE {_SERIES}, r AS (SELECT series, -1::BIGINT AS n, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM s WHERE n = 0 UNION ALL SELECT r.series, s.n, r.a + (s.x * s.x - r.a) / 5, r.b + (s.x * s.x - r.b) / 25 FROM r JOIN s ON s.series = r.series AND s.n = r.n + 1)
SELECT event_id, round(CASE WHEN n >= 25 THEN a / b ELSE 0 END, 8) AS ratio FROM r JOIN s USING (series, n)""")
def sta_lta_ratio(spark, sf):
    s = samples(spark, sf)
    return s.join(signals.recursive_ratio(s.select("series", "n", "x"), 5, 25), ["series", "n"]).select("event_id", F.round("ratio", 8).alias("ratio"))


def depths(spark, sf):
    """Hourly means of a made depth a series: the events' values on two waves, every thirteenth hour unknown."""
    e = load(spark, sf, "events").withColumn("hours", F.floor(epoch_seconds("ts") / 3600).cast("double"))
    wave = sum((F.cos(F.col("hours") * (6.283185307179586 * signals.TIDES[k])) * a for k, a in (("M2", 90.0), ("K1", 40.0))), F.col("value"))
    return e.groupBy((F.col("user_id") % 2).alias("series"), "hours").agg(F.avg(wave).alias("x")).select("series", "hours", F.when(F.col("hours") % 13 != 0, F.col("x")).alias("x"))


@query()
def tidal_fit(spark, sf):
    """No SQL: a least-squares solution; tested against a dense fit. A month of hours tells these four waves apart."""
    return signals.tides(depths(spark, sf), {k: signals.TIDES[k] for k in ("M2", "S2", "K1", "O1")}).select("series", "hours", F.round("tide", 6).alias("tide"), F.round(F.col("x") - F.col("tide"), 6).alias("detided"))
