"""Operator 9: sharding by longest-processing-time (LPT) scheduling.

Groups of equal texts stay together. Groups go in order of falling size to the
least-loaded shard. Groups of the same size are interchangeable, so the heap
works on *size classes*: the driver sees one (size, number of groups) pair for
each distinct group size and returns how many groups of the class each shard
takes. With D distinct sizes the total size is at least D(D+1)/2, so
D <= sqrt(2 * total bytes): the driver's work has a proven bound that is far
below the number of rows or groups, and no list of groups leaves the executors.

Defined cases: a null text has no bytes (size 1, crc 0) and all null texts are
one group, apart from the empty text; repeated rows and repeated ids are kept,
each with its own slot; null ids sort first; an empty table gives no rows;
columns of the input other than ``doc_id`` and ``text`` are ignored; a very long
text counts by its bytes like any other; equal loads go to the smaller shard; in a
shard, rows tied on the id are slotted by checksum and size. A group
larger than an equal share (say a third of all rows) makes its shard that
large, since groups are never split.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SALTS = 64
SLOT_BUCKETS = 512


def allot(classes: Iterable[tuple[int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """How many groups of each size class each shard takes under LPT.

    ``classes``: (size, count) pairs. n equal items on the least-loaded shard,
    one after the other, take the n smallest start loads among
    ``load[i] + k * size``; a search on that threshold places whole classes at
    once and the heap places the rest, with ties to the smaller shard.
    """
    loads = [0] * shards
    out = []
    for size, count in sorted(classes, reverse=True):
        taken = [0] * shards
        if count > 4 * shards:
            lo, hi = min(loads), max(loads) + size * count

            def below(limit: int, size: int = size) -> list[int]:
                return [max(0, -(-(limit - x) // size)) for x in loads]

            while lo < hi:
                mid = (lo + hi + 1) // 2
                if sum(below(mid)) <= count:
                    lo = mid
                else:
                    hi = mid - 1
            taken = below(lo)
        heap = [(x + t * size, i) for i, (x, t) in enumerate(zip(loads, taken, strict=True))]
        heapq.heapify(heap)
        for _ in range(count - sum(taken)):
            load, i = heap[0]
            taken[i] += 1
            heapq.heapreplace(heap, (load + size, i))
        loads = [x + t * size for x, t in zip(loads, taken, strict=True)]
        out.append((size, taken))
    return out


def _running(taken: list[int]) -> list[int]:
    total, out = 0, []
    for t in taken:
        total += t
        out.append(total)
    return out


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    spark = docs.sparkSession
    # Each step is written once, so texts are read once and no stage holds more than one join.
    rows = common.materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
            F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2(F.col("text"), 256)), F.lit("null").cast("binary")).alias("group_key"),
        ),
        "shard-rows",
    )
    groups = common.materialize(
        rows.groupBy("group_key")
        .agg(F.sum("size").alias("group_size"))
        .withColumn("salt", F.pmod(F.xxhash64("group_key"), F.lit(SALTS)).cast("int")),
        "shard-groups",
    )
    histogram = common.materialize(groups.groupBy("group_size", "salt").agg(F.count(F.lit(1)).alias("n")), "shard-sizes")
    sizes = histogram.groupBy("group_size").agg(F.sum("n").alias("n")).collect()
    plan = [
        (int(size), _running(taken))
        for size, taken in allot(((r["group_size"], r["n"]) for r in sizes), shards)
    ]
    plan_df = spark.createDataFrame(plan, "group_size long, upto array<long>")
    before = Window.partitionBy("group_size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    classes = histogram.select(
        "group_size", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    ).join(plan_df, "group_size")
    in_class = Window.partitionBy("group_size", "salt").orderBy("group_key")
    placed = common.materialize(
        groups.withColumn("rank", F.row_number().over(in_class))
        .join(classes, ["group_size", "salt"])
        .select(
            "group_key",
            F.size(F.filter("upto", lambda u: u < F.col("offset") + F.col("rank"))).alias("shard"),
        ),
        "shard-placed",
    )
    # Slots: ids are dealt to buckets inside a shard; the small bucket counts give each bucket its offset.
    dealt = common.materialize(
        rows.join(placed, "group_key")
        .drop("group_key")
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(SLOT_BUCKETS)).cast("int")),
        "shard-dealt",
    )
    counts = dealt.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    up_to = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("first"))
    in_bucket = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        dealt.withColumn("position", F.row_number().over(in_bucket) - F.lit(1))
        .join(F.broadcast(offsets), ["shard", "bucket"])  # at most shards * SLOT_BUCKETS rows
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("first") + F.col("position")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
