"""Windows over long groups: rows are numbered by sorted ranges and cut into blocks, so no group is one task's.

Row windows see a block's own rows and the few of its neighbours that they reach; running
aggregates add what all blocks before have, which is one row a block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.shared import materialize

BLOCK = 1 << 16


def numbered_in_order(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with each row's place from 0 by ``order``, without a sort in one task: sorted ranges, and the sizes of those before."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    held = materialize(sorted_, "ordered").withColumn("_range", F.shiftright("_m", 33))
    sizes = held.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_m").bitwiseAND((1 << 33) - 1)
    return held.join(F.broadcast(before), "_range").withColumn(name, place).drop("_range", "_m", "_before")  # a row a partition


def over_rows(df: DataFrame, keys: list[str], order: list[str], before: int, after: int, make: Callable[[Callable[[int, int], WindowSpec]], list[Column]], block: int = BLOCK) -> DataFrame:
    """``df`` with the columns of ``make``, which gets frame(first, last) -> window over rows; frames reach at most ``before`` rows back and ``after`` on.

    ``order`` must tell the rows of a group apart.
    """
    placed = numbered_in_order(df, [*keys, *order], "_at")
    own = F.floor(F.col("_at") / block)
    # A row is seen by its own block and by those whose rows reach it.
    seen = F.sequence(F.floor(F.greatest(F.col("_at") - after, F.lit(0)) / block), F.floor((F.col("_at") + before) / block))
    dealt = placed.select("*", own.alias("_own"), F.explode(seen).alias("_block"))
    window = Window.partitionBy(*keys, "_block").orderBy("_at")
    out = dealt.select("*", *make(lambda first, last: window.rowsBetween(first, last)))
    return out.where("_own = _block").drop("_own", "_block", "_at")


def running(df: DataFrame, keys: list[str], order: list[str], value: str, block: int = BLOCK) -> DataFrame:
    """``df`` with running_sum and running_max of ``value`` within ``keys`` by ``order``, null values left out."""
    placed = numbered_in_order(df, [*keys, *order], "_at").withColumn("_block", F.floor(F.col("_at") / block))
    totals = placed.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"), F.max(value).alias("_max"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "_block", F.sum("_sum").over(earlier).alias("_sum"), F.max("_max").over(earlier).alias("_max"))
    inside = Window.partitionBy(*keys, "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    here = placed.select("*", F.sum(value).over(inside).alias("_s"), F.max(value).over(inside).alias("_x")).join(carried, [*keys, "_block"])
    total = F.when(F.col("_sum").isNull(), F.col("_s")).otherwise(F.col("_sum") + F.coalesce("_s", F.lit(0)))
    return here.withColumn("running_sum", total).withColumn("running_max", F.greatest("_x", "_max")).drop("_at", "_block", "_sum", "_max", "_s", "_x")


def running_sums(df: DataFrame, keys: list[str], order: list[str], values: list[str], block: int = BLOCK) -> DataFrame:
    """``df`` with running_<value> for several values in one pass; a null counts as nothing."""
    placed = numbered_in_order(df, [*keys, *order], "_at").withColumn("_block", F.floor(F.col("_at") / block))
    totals = placed.groupBy(*keys, "_block").agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(f"_t_{v}") for v in values])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "_block", *[F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_b_{v}") for v in values])
    inside = Window.partitionBy(*keys, "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    here = placed.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_s_{v}") for v in values]).join(carried, [*keys, "_block"])
    own = [c for c in df.columns]
    return here.select(*own, *[(F.col(f"_b_{v}") + F.col(f"_s_{v}")).alias(f"running_{v}") for v in values])
