"""Sinks: canonical JSON lines, atomic publication, append without repeats, packed integers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(df: DataFrame) -> DataFrame:
    """One JSON line per row, keys sorted, no spaces, nulls kept out."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def publish(df: DataFrame, path: str, check: Callable[[DataFrame], str | None]) -> None:
    """Write beside ``path``, validate what was written, then rename it into place.

    ``check`` returns a complaint or None. The old build steps aside by a rename and is
    deleted only when the new one is in place, or steps back if that fails. Readers of
    ``path`` see the old build or the new one, or, between two renames, none; never a part.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    staging = f"{path}.building"
    df.write.mode("overwrite").parquet(staging)
    complaint = check(spark.read.parquet(staging))
    if complaint:
        raise ValueError(complaint)
    old, new, aside = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, staging, f"{path}.before"))
    fs = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(old):
        fs.delete(aside, True)
        if not fs.rename(old, aside):
            raise OSError(f"{path} could not be renamed")
    if not fs.rename(new, old):
        if fs.exists(aside):
            fs.rename(aside, old)
        raise OSError(f"{staging} could not be renamed")
    fs.delete(aside, True)


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose keys the table at ``path`` does not hold (insert, do nothing on conflict)."""
    known = df.sparkSession.read.parquet(path).select(*keys)
    df.dropDuplicates(keys).join(known, keys, "left_anti").write.mode("append").parquet(path)


def packed(value: Column, scale: float) -> Column:
    """A fixed-point integer: round(value * scale)."""
    return F.round(value * scale).cast("int")
