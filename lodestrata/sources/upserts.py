"""A table kept up to date by batches, each applied once: versions beside each other and a pointer to the one that holds.

A version is written whole before the pointer names it, and the pointer is one small file that is
replaced by a rename, so readers always find a whole version, and a crash leaves the old one.
The pointer also names the last batch: a batch that a restarted stream gives again is left out.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POINTER = "current.json"
KEPT = 2


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def pointer(spark: SparkSession, path: str) -> dict | None:
    """What the pointer says: version, batch; None before the first batch."""
    fs, at = _fs(spark, path)
    file = at(path, POINTER)
    if not fs.exists(file):
        old = at(path, f"{POINTER}.old")
        if not fs.exists(old):
            return None
        file = old  # a crash between the two renames below
    stream = fs.open(file)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _point(spark: SparkSession, path: str, said: dict) -> None:
    fs, at = _fs(spark, path)
    new, current, old = at(path, f"{POINTER}.{uuid.uuid4().hex}"), at(path, POINTER), at(path, f"{POINTER}.old")
    out = fs.create(new)
    out.write(bytearray(json.dumps(said).encode()))
    out.close()
    if fs.exists(current):
        fs.delete(old, False)
        fs.rename(current, old)
    if not fs.rename(new, current):
        raise OSError(f"{path}: the pointer could not be replaced")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The version that holds."""
    said = pointer(spark, path)
    if said is None:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/{said['version']}")


def publish(df: DataFrame, path: str, check=None, batch: int | None = None) -> str:
    """Write ``df`` as the next version and let the pointer name it, unless ``check`` of what was written has a complaint."""
    spark = df.sparkSession
    said = pointer(spark, path)
    version = f"version-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    complaint = check(spark.read.parquet(f"{path}/{version}")) if check else None
    fs, at = _fs(spark, path)
    if complaint:
        fs.delete(at(path, version), True)
        raise ValueError(complaint)
    before = ([said["version"], *said.get("before", [])] if said else [])[:KEPT]
    _point(spark, path, {"version": version, "before": before[: KEPT - 1], "batch": batch if batch is not None else (said or {}).get("batch", -1)})
    for old in before[KEPT - 1 :]:  # readers of the version before this one may still be at work
        fs.delete(at(path, old), True)
    return version


def merged(current: DataFrame | None, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``current`` after ``changes``, rows with the same columns, an order and deleted: of a key's changes the last counts.

    A change that is not after what the table holds says nothing new. A deletion leaves the key's row out; it is kept as
    a row of nulls with its order, so that an older change that comes later does not bring the key back.
    """
    newest = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("deleted"))
    both = changes if current is None else current.unionByName(changes)
    # Of equal orders the table's own row stays: it came first.
    ranked = both.withColumn("_k", F.row_number().over(newest))
    return ranked.where("_k = 1").drop("_k")


def apply(batch: DataFrame, batch_id: int, path: str, keys: list[str], order: str) -> bool:
    """One batch of changes; False if it was applied before."""
    spark = batch.sparkSession
    said = pointer(spark, path)
    if said is not None and said["batch"] >= batch_id:
        return False
    current = None if said is None else read(spark, path)
    publish(merged(current, batch, keys, order), path, batch=batch_id)
    return True


def live(table: DataFrame) -> DataFrame:
    return table.where(~F.col("deleted")).drop("deleted")


def missing(table: DataFrame, listing: DataFrame, keys: list[str], order: str, at) -> DataFrame:
    """Deletions, of order ``at``, for the live rows that a whole listing no longer has."""
    gone = live(table).join(listing.select(*keys), keys, "left_anti")
    kept = [F.col(c) if c in keys else F.lit(at).cast(table.schema[c].dataType).alias(c) if c == order else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns if c != "deleted"]
    return gone.select(*kept, F.lit(True).alias("deleted"))
