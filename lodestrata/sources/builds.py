"""Checks of a build's inputs and builds that resume."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shipping import ship


def verify_files(spark: SparkSession, root: str, catalog: DataFrame) -> DataFrame:
    """(path, problem) of a catalog (path below ``root``, byte_size, sha256, records); problem is null for a sound file.

    Files are read by Spark, one task a file, up to the 2 GB its binary reader takes. ``records`` counts the lines
    that are not blank and may be declared for .jsonl only; null declares none.
    """
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    at = F.instr("path", base)  # what stands before the root is the store's name
    lines = F.size(F.filter(F.split(F.col("content").cast("string"), "\n"), lambda x: F.trim(x) != ""))
    seen = files.where(at > 0).select(F.substr("path", at + len(base)).alias("path"), F.col("length").alias("_size"), F.sha2("content", 256).alias("_sha"), F.when(F.col("path").endswith(".jsonl"), lines).alias("_lines"))
    problem = (
        F.when(F.col("_size").isNull(), "missing")
        .when(~F.col("byte_size").eqNullSafe(F.col("_size")), "byte size")
        .when(~F.col("sha256").eqNullSafe(F.col("_sha")), "sha-256")
        .when(F.col("records").isNotNull() & F.col("_lines").isNull(), "records of a file without lines")
        .when(F.col("records") != F.col("_lines"), "record count")
    )
    return catalog.join(seen, "path", "left").select("path", problem.alias("problem"))


def mark(records: DataFrame, key: str, content: str) -> dict[str, str]:
    """Row count and a fingerprint of (key, content) that does not depend on order: one aggregate, no sort."""
    digest = F.sha2(F.concat_ws("\x1f", F.col(key).cast("string"), F.coalesce(F.col(content), F.lit("\x00"))), 256)
    parts = [F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    n, *sums = records.agg(F.count(F.lit(1)), *parts).first()
    return {"record_count": str(n), "rows": "-".join(str(int(s or 0)) for s in sums)}


def digest_in_order(values: DataFrame, column: str) -> DataFrame:
    """One row: fingerprint, the SHA-256 of the strings of ``column`` sorted and joined by commas, nulls left out, and n, the count of all rows.

    Tasks sort ranges and join them to blocks; one task digests the blocks as they come and holds a batch of them.
    The fingerprint of no rows is null.
    """
    ship(values.sparkSession)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).drop_null()
            block = pa.array([",".join(own.to_pylist())] if len(own) else [None], pa.string())
            ends = [pa.array([own[i].as_py() if len(own) else None], pa.string()) for i in (0, -1)]
            yield pa.RecordBatch.from_arrays([*ends, block, pa.array([batch.num_rows], pa.int64())], ["first", "last", "block", "n"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, n, some = hashlib.sha256(), 0, False
        for batch in batches:
            for block, rows in zip(batch.column("block"), batch.column("n").to_pylist(), strict=True):
                n += rows
                if block.is_valid:
                    digest.update(("," if some else "").encode() + block.as_py().encode())
                    some = True
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest() if n else None], pa.string()), pa.array([n], pa.int64())], ["fingerprint", "n"])

    # Blocks are runs of one order, so their ends put them back into it, equal values too.
    blocks = values.select(column).orderBy(F.col(column).asc_nulls_first()).mapInArrow(joined, "first string, last string, block string, n long")
    none = values.sparkSession.createDataFrame([(None, None, None, 0)], blocks.schema)  # so that the one task runs without rows as well
    return blocks.unionByName(none).repartition(1).sortWithinPartitions(F.col("first").asc_nulls_first(), "last").mapInArrow(digested, "fingerprint string, n long")


def resume(records: DataFrame, path: str, required: dict[str, str], key: str, content: str) -> DataFrame:
    """Rows of ``records`` that the build at ``path`` has still to do.

    The first call notes what the build rests on: ``required`` (model, revision, ...) and the rows themselves.
    A later call with anything else raises ValueError; so does one whose batches are of other rows.
    """
    spark = records.sparkSession
    wanted = {**required, **mark(records, key, content)}
    if not _exists(spark, f"{path}/progress"):
        spark.createDataFrame(sorted(wanted.items()), "name string, value string").coalesce(1).write.json(f"{path}/progress")
    noted = {r["name"]: r["value"] for r in spark.read.schema("name string, value string").json(f"{path}/progress").collect()}  # a few names
    for name in sorted(wanted.keys() | noted.keys()):
        if noted.get(name) != wanted.get(name):
            raise ValueError(f"cannot resume: {name} changed")
    if not _exists(spark, f"{path}/rows"):
        return records
    return records.join(spark.read.parquet(f"{path}/rows").select(key).distinct(), key, "left_anti")


def add_batch(batch: DataFrame, path: str) -> None:
    """Append finished rows; Spark commits a batch whole or not at all."""
    batch.write.mode("append").parquet(f"{path}/rows")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))
