"""Interval and gap algebra over (key, start, end) and (key, time, value) rows.

All operators are window aggregates partitioned by the series key; none moves a
series to Python. Series keys with many rows are a property of the data: where
a series may be unbounded, partition it first by a period (day, month) too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage(spans: DataFrame, keys: list[str], start: str, end: str, lo: Column, hi: Column) -> DataFrame:
    """Covered share of [lo, hi), longest gap in minutes (edges included) and the last covered time, per key."""
    clipped = spans.select(*keys, F.greatest(F.col(start), lo).alias("a"), F.least(F.col(end), hi).alias("b"), lo.alias("lo"), hi.alias("hi")).where("b > a")
    w = Window.partitionBy(*keys).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    walked = clipped.withColumn("cursor", F.greatest(F.coalesce(F.max("b").over(w), F.col("lo")), F.col("lo")))
    return (
        walked.groupBy(*keys, "lo", "hi")
        .agg(
            F.sum(F.greatest(F.lit(0.0), F.col("b") - F.greatest("a", "cursor"))).alias("covered"),
            F.max(F.greatest(F.lit(0.0), F.col("a") - F.col("cursor"))).alias("inner_gap"),
            F.max("b").alias("last"),
        )
        .select(
            *keys,
            (F.col("covered") / (F.col("hi") - F.col("lo"))).alias("coverage"),
            (F.greatest(F.col("inner_gap"), F.col("hi") - F.col("last")) / 60).alias("longest_gap_min"),
            "last",
        )
    )


def grade(coverage_: Column, longest: Column, allowed: float) -> Column:
    return F.when(coverage_ <= 0, "no_data").when(longest > allowed, "gaps").otherwise("ok")


def two_witnesses(first: Column, second: Column, second_coverage: Column, passed: Column) -> tuple[Column, Column]:
    """(state, whether the witnesses agree) of a first witness checked against a second one.

    A null first state leaves the second's, with nothing to agree on; a null second
    state is 'no_data'. The second's data show that the instrument recorded; its gap,
    or its silence in a window that it has already ``passed``, makes a good window
    'gaps'; where it has not come so far, its silence says nothing against the first.
    """
    other, covered = F.coalesce(second, F.lit("no_data")), F.coalesce(second_coverage, F.lit(0.0))
    silent = other == "no_data"
    state = (
        F.when(first.isNull(), other)
        .when((first == "no_data") & (covered > 0), other)
        .when((first == "ok") & ((other == "gaps") | (silent & passed)), "gaps")
        .otherwise(first)
    )
    return state, F.when(first.isNotNull(), (first == other) | (silent & ~passed))


def severity(state: Column) -> Column:
    return F.when(state == "ok", 0).when(state == "gaps", 1).when(state == "no_data", 2)


def runs(df: DataFrame, keys: list[str], order: list[str], changed: Column, out: str = "run") -> DataFrame:
    """Number the runs of rows: a new one starts wherever ``changed`` holds (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.sum(F.coalesce(changed, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def merged(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Overlapping or touching spans joined."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reached = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("_reached", reached)
    grouped = runs(opened, keys, [start, end], F.col(start) > F.col("_reached"), "_run")
    return grouped.groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def complement(spans: DataFrame, keys: list[str], start: str, end: str, lo: Column, hi: Column) -> DataFrame:
    """[lo, hi) of each key without its spans."""
    clipped = spans.select(*keys, F.greatest(F.col(start), lo).alias(start), F.least(F.col(end), hi).alias(end)).where(F.col(end) > F.col(start))
    m = merged(clipped, keys, start, end)
    w = Window.partitionBy(*keys).orderBy(start)
    after = m.select(*keys, F.col(end).alias("free_from"), F.coalesce(F.lead(start).over(w), hi).alias("free_to"))
    before = m.groupBy(*keys).agg(lo.alias("free_from"), F.min(start).alias("free_to"))
    return after.unionByName(before).where("free_to > free_from")


def gaps_by_period(samples: DataFrame, keys: list[str], t: str) -> DataFrame:
    """Gap statistics from the typical step: median of the steps up to their 90th percentile.

    Multipliers for the gap threshold are fixed values by period and by whether
    the series is about as long as expected.
    """
    w = Window.partitionBy(*keys).orderBy(t)
    steps = samples.withColumn("d", F.col(t) - F.lag(t).over(w))
    cut = steps.where("d > 0").groupBy(*keys).agg(F.expr("percentile(d, 0.9)").alias("p90"))
    typical = steps.where("d > 0").join(cut, keys).where("d <= p90").groupBy(*keys).agg(F.expr("percentile(d, 0.5)").alias("period"))
    extent = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.max(t) - F.min(t)).alias("duration"))
    sized = (
        extent.join(typical, keys)
        .withColumn("expected", F.bround(F.col("duration") / F.col("period"), 0) + 1)
        .withColumn("full", F.abs(F.col("n") - F.col("expected")) <= F.greatest(F.lit(5.0), F.floor(F.col("expected") * 0.001)))
    )
    multiplier = (
        F.when(F.col("period") >= 10, F.when(F.col("full"), 4.0).otherwise(3.0))
        .when(F.col("period") >= 0.5, F.when(F.col("full"), 3.5).otherwise(2.5))
        .otherwise(F.when(F.col("full"), 2.5).otherwise(2.0))
    )
    sized = sized.withColumn("threshold", multiplier * F.col("period"))
    return (
        steps.join(sized, keys)
        .groupBy(*keys, "n", "period", "expected", "full", "threshold")
        .agg(
            F.count_if(F.col("d") > F.col("threshold")).alias("n_gaps"),
            F.coalesce(F.sum(F.when(F.col("d") > F.col("threshold"), F.bround(F.col("d") / F.col("period"), 0) - 1)), F.lit(0.0)).alias("missing"),
        )
    )


def gaps_by_fit(samples: DataFrame, keys: list[str], t: str) -> DataFrame:
    """Gap statistics from integer sample numbers and a least-squares period."""
    w = Window.partitionBy(*keys).orderBy(t)
    steps = samples.withColumn("d", F.col(t) - F.lag(t).over(w))
    guess = steps.where("d IS NOT NULL").groupBy(*keys).agg(F.expr("percentile(d, 0.5)").alias("guess"))
    numbered = (
        steps.join(guess.where("guess > 0"), keys)
        .withColumn("step", F.bround(F.col("d") / F.col("guess"), 0))
        .withColumn("number", F.coalesce(F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
        .withColumn("first", F.min(t).over(Window.partitionBy(*keys)))
    )
    fit = numbered.groupBy(*keys, "guess").agg(
        F.regr_slope(F.col(t) - F.col("first"), F.col("number")).alias("period"),
        (F.max("number") + 1).alias("ideal"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("step") > 1).alias("raw_gaps"),
    ).where("period > 0")
    residual = F.col(t) - F.col("first") - F.col("number") * F.col("period")
    return (
        numbered.join(fit.drop("guess"), keys)
        .groupBy(*keys, "guess", "period", "ideal", "n", "raw_gaps")
        .agg(F.max(F.abs(residual / F.col("period"))).alias("worst"), (F.stddev_pop(residual) * 1000).alias("sigma_ms"))
        .withColumn("true_missing", F.greatest(F.lit(0.0), F.col("ideal") - F.col("n")))
        .withColumn("n_gaps", F.when(F.col("true_missing") > 0, F.col("raw_gaps")).otherwise(F.lit(0)))
    )


def interpolate(anchors: DataFrame, targets: DataFrame, keys: list[str], t: str, v: str) -> DataFrame:
    """Linear interpolation of ``v`` at the target times; null outside the anchors."""
    both = anchors.select(*keys, t, F.col(v).alias("_v"), F.col(t).alias("_at"), F.lit(False).alias("_asked")).unionByName(
        targets.select(*keys, t, F.lit(None).cast("double").alias("_v"), F.lit(None).cast("double").alias("_at"), F.lit(True).alias("_asked"))
    )
    w = Window.partitionBy(*keys).orderBy(t, "_asked")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    spread = both.select(
        *keys, t, "_asked",
        F.last("_v", True).over(back).alias("v0"), F.last("_at", True).over(back).alias("t0"),
        F.first("_v", True).over(ahead).alias("v1"), F.first("_at", True).over(ahead).alias("t1"),
    ).where("_asked")
    exact = F.col("t0") == F.col(t)
    slope = (F.col("v1") - F.col("v0")) / (F.col("t1") - F.col("t0"))
    return spread.select(*keys, t, F.when(exact, F.col("v0")).otherwise(F.col("v0") + slope * (F.col(t) - F.col("t0"))).alias(v))


def decimate(samples: DataFrame, keys: list[str], t: str, v: str, most: int) -> DataFrame:
    """At most ``most`` samples per key: each bucket's smallest and largest value, the earliest on ties, in time order."""
    w = Window.partitionBy(*keys)
    numbered = samples.withColumn("_rn", F.row_number().over(w.orderBy(t)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    size = F.ceil(F.col("_n") / F.lit(most // 2))
    bucketed = numbered.withColumn("_bucket", F.when(F.col("_n") <= most, F.col("_rn")).otherwise(F.floor(F.col("_rn") / size)))
    extremes = bucketed.groupBy(*keys, "_bucket").agg(
        F.min(F.struct(F.col(v), F.col(t))).alias("low"), F.max(F.struct(F.col(v), (-F.col(t)).alias("back"))).alias("high")
    )
    low = extremes.select(*keys, F.col(f"low.{t}").alias(t), F.col(f"low.{v}").alias(v))
    high = extremes.select(*keys, (-F.col("high.back")).alias(t), F.col(f"high.{v}").alias(v))
    return low.unionByName(high).distinct()
