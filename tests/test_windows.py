"""Windows over blocks against windows over whole groups."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.operators import windows


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_blocks_change_nothing(spark, block):
    df = spark.range(300).select((F.col("id") % 7 % 3).alias("k"), (F.col("id") * 37 % 300).alias("t"), F.when(F.col("id") % 11 != 0, F.col("id") * 7 % 50).alias("v"), "id").repartition(5)
    w = Window.partitionBy("k").orderBy("t")
    want = df.select("id", F.sum("v").over(w.rowsBetween(-4, 2)).alias("a"), F.lag("v").over(w).alias("b"))
    got = windows.over_rows(df, ["k"], ["t"], 4, 2, lambda frame: [F.sum("v").over(frame(-4, 2)).alias("a"), F.first("v").over(frame(-1, -1)).alias("b")], block).select("id", "a", "b")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("id", F.sum("v").over(upto).alias("s"), F.max("v").over(upto).alias("m"))
    got = windows.running(df, ["k"], ["t"], "v", block).select("id", F.col("running_sum").alias("s"), F.col("running_max").alias("m"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert windows.running(df.limit(0), ["k"], ["t"], "v").count() == 0
