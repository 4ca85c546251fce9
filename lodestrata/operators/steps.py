"""Steps in two-axis series told by kind and taken out, live corrections of stored states, and gaps by the fitting detector."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import intervals, windows

HOUR = 3600.0
#: Marks within half an hour are one step; what counts as level and as a relevel; minutes of a day.
MERGE, LEVEL, RELEVEL = 1800.0, 25.0, 50.0
DAY_MINUTES, USUAL_GAP = 1440, 60
LEAST_FOR_FIT = 100


def detect_steps(samples: DataFrame, keys: list[str], jump: float, gap_jump: float) -> DataFrame:
    """keys, start, end, kind ('relevel', 'across gap' or 'step'), hours, dx, dy of rows of keys, t, x, y.

    A mark is a change of more than ``jump`` on either axis within an hour, or of more than ``gap_jump`` over a longer
    pause; marks within ``MERGE`` of the last one belong to its step, but a pause begins its own. A step runs from the row
    before its first mark to its last mark. Its size is the medians of the hour after it less those of the hour up to
    it; one whose size is below ``jump`` is back where it was and no step.
    """
    ok = samples.where("x IS NOT NULL AND y IS NOT NULL")
    before = lambda frame: [F.first(c).over(frame(-1, -1)).alias(f"p{c}") for c in ("t", "x", "y")]
    moved = windows.over_rows(ok, keys, ["t"], 1, 0, before)
    change = F.greatest(F.abs(F.col("x") - F.col("px")), F.abs(F.col("y") - F.col("py")))
    dt = F.col("t") - F.col("pt")
    gap = (dt > HOUR) & (change > gap_jump)
    marks = moved.where(((change > jump) & (dt <= HOUR)) | gap).select(*keys, "t", "pt", gap.alias("gap"))
    order = Window.partitionBy(*keys).orderBy("t")
    opens = F.col("gap") | F.coalesce(F.col("t") - F.lag("t").over(order) > MERGE, F.lit(True))
    grouped = marks.withColumn("step", F.sum(opens.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    steps = grouped.groupBy(*keys, "step").agg(F.min("pt").alias("start"), F.max("t").alias("end"))
    # A step looks at the hours it and its neighbourhood touch: an equality on hours, then the exact times.
    seen = steps.withColumn("hour", F.explode(F.array_distinct(F.array(*[F.floor((F.col(c) + d) / HOUR) for c, d in (("start", -HOUR), ("start", 0.0), ("end", 0.0), ("end", HOUR))]))))
    near = ok.withColumn("hour", F.floor(F.col("t") / HOUR)).join(seen, [*keys, "hour"])
    early = (F.col("t") > F.col("start") - HOUR) & (F.col("t") <= F.col("start"))
    late = (F.col("t") >= F.col("end")) & (F.col("t") < F.col("end") + HOUR)
    medians = [F.percentile(F.when(side, F.col(c)), 0.5).alias(f"{c}_{name}") for name, side in (("before", early), ("after", late)) for c in ("x", "y")]
    sized = near.groupBy(*keys, "step", "start", "end").agg(*medians)
    sized = sized.withColumn("dx", F.col("x_after") - F.col("x_before")).withColumn("dy", F.col("y_after") - F.col("y_before"))
    size, rest = F.greatest(F.abs("dx"), F.abs("dy")), F.greatest(F.abs("x_after"), F.abs("y_after"))
    hours = (F.col("end") - F.col("start")) / HOUR
    kind = F.when((rest < LEVEL) & (size > RELEVEL), "relevel").when(hours > 1, "across gap").otherwise("step")
    return sized.where(size >= jump).select(*keys, "start", "end", kind.alias("kind"), hours.alias("hours"), "dx", "dy")


def stitched(samples: DataFrame, steps: DataFrame, keys: list[str], kinds: list[str]) -> DataFrame:
    """``samples`` with x_stitched and y_stitched: steps of ``kinds`` taken out of all that follows, null within them."""
    removed = steps.where(F.col("kind").isin(kinds))
    nothing = F.lit(None).cast("double")
    rows = samples.select(*keys, "t", F.lit(1).alias("rank"), F.struct(*samples.columns).alias("row"), nothing.alias("dx"), nothing.alias("dy"), F.lit(0).alias("inside"))
    none = F.lit(None).cast(rows.schema["row"].dataType).alias("row")
    begins = removed.select(*keys, F.col("start").alias("t"), F.lit(2).alias("rank"), none, nothing.alias("dx"), nothing.alias("dy"), F.lit(1).alias("inside"))
    ends = removed.select(*keys, F.col("end").alias("t"), F.lit(0).alias("rank"), none, "dx", "dy", F.lit(-1).alias("inside"))
    summed = windows.running_sums(rows.unionByName(begins).unionByName(ends), keys, ["t", "rank"], ["dx", "dy", "inside"]).where("rank = 1")
    free = F.col("running_inside") <= 0
    return summed.select("row.*", F.when(free, F.col("row.x") - F.col("running_dx")).alias("x_stitched"), F.when(free, F.col("row.y") - F.col("running_dy")).alias("y_stitched"))


def live_states(rows: DataFrame, live: DataFrame, now: float, since: float | None, checker: str) -> DataFrame:
    """sensor, state, since (a day), live, daily_state: stored states corrected by a checker's live word.

    ``rows``: sensor, state, since, last (seconds of its last data), gap (minutes allowed), source, agree. ``live``: sensor,
    verdict, delay (minutes). The word counts if it is given, not UNMONITORED, and the sensor is not diverted. BAD: a
    sensor without data for a day, or for a time that nobody knows, has no data, one silent for longer than its gap
    has gaps; when it stopped is its last data, else the delay, and for a sensor that the report saw recording not before
    the report's beginning ``since``. GOOD and WARN clear 'no_data' and 'gaps' that the checker itself had set and no other witness did.
    """
    said = rows.join(live, "sensor", "left")
    c = F.col
    counts = c("verdict").isNotNull() & (c("verdict") != "UNMONITORED") & (c("state") != "diverted")
    stopped = F.coalesce(c("last"), F.lit(now) - c("delay") * 60)
    if since is not None:
        stopped = F.when(stopped.isNotNull() & (c("state") != "no_data"), F.greatest(stopped, F.lit(since))).otherwise(stopped)
    told = said.withColumn("stopped", stopped).withColumn("minutes", (F.lit(now) - F.col("stopped")) / 60)
    bad = counts & (c("verdict") == "BAD")
    dead = bad & (c("minutes").isNull() | (c("minutes") >= DAY_MINUTES))
    gaps = bad & ~dead & (c("minutes") > F.coalesce("gap", F.lit(USUAL_GAP)))
    clears = counts & c("verdict").isin("GOOD", "WARN") & c("state").isin("no_data", "gaps") & c("source").startswith(checker) & F.coalesce(c("agree"), F.lit(True))
    day = F.date_format(F.timestamp_seconds("stopped"), "yyyy-MM-dd")
    state = F.when(dead, "no_data").when(gaps, "gaps").when(clears, "ok").otherwise(c("state"))
    held = F.when(dead, F.when(c("state") == "no_data", c("since")).otherwise(F.coalesce(day, c("since")))).when(gaps, day).when(clears, None).otherwise(c("since"))
    changed = F.coalesce(dead | gaps | clears, F.lit(False))
    return told.select("sensor", state.alias("state"), held.alias("since"), changed.alias("live"), F.when(changed, c("state")).alias("daily_state"))


def detect_gaps(samples: DataFrame, keys: list[str], t: str, least: int = LEAST_FOR_FIT) -> DataFrame:
    """keys, method, n, period, n_gaps, missing, unstable: sample numbers fitted by least squares, or, below ``least`` samples, the typical step.

    ``unstable``: a sample is more than 0.4 periods from where its number puts it.
    """
    sizes = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    long, short = (samples.join(sizes.where(c), keys, "left_semi") for c in (F.col("_n") >= least, F.col("_n") < least))
    fitted = intervals.gaps_by_fit(long, keys, t)
    typical = intervals.gaps_by_period(short, keys, t)
    row = lambda method, missing, unstable: [*keys, F.lit(method).alias("method"), "n", "period", F.col("n_gaps").cast("long").alias("n_gaps"), missing.alias("missing"), unstable.alias("unstable")]
    return fitted.select(*row("fit", F.col("true_missing"), F.col("worst") > 0.4)).unionByName(typical.select(*row("step", F.col("missing"), F.lit(None).cast("boolean"))))
