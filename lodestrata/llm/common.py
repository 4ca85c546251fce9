"""Helpers shared by the operators: tables, shared storage, shipping of code."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import fresh_path, materialize, shared_dir  # noqa: F401
from ..sources.shipping import give_back, ship, tidy  # noqa: F401

Batches = Iterator[pa.RecordBatch]


def process_cache() -> dict:
    """A store that lives as long as the worker process, whatever copy of this module a task holds."""
    return sys.modules.setdefault("lodestrata_process_cache", types.ModuleType("lodestrata_process_cache")).__dict__


def slices(batch: pa.RecordBatch, most: int, column: str = "text", rows: int = 1024) -> Batches:
    """Runs of at most ``rows`` rows and, but for a single longer text, ``most`` bytes of ``column``."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    lo = 0
    while lo < batch.num_rows:
        before = int(ends[lo - 1]) if lo else 0
        hi = min(max(int(np.searchsorted(ends, before + most, "right")), lo + 1), lo + rows, batch.num_rows)
        yield batch.slice(lo, hi - lo)
        lo = hi


def tokenizer_path(name: str) -> str:
    """Where the installed public vocabulary file ``name`` is."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, underscored until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted
