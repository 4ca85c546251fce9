"""Sends this package to the executors, so that Python stages find it whatever the workers' paths, and gives their memory back."""

from __future__ import annotations

import gc
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
Batches = Iterator[pa.RecordBatch]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application; Spark serves the archive to every executor, lost and new ones too."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="lodestrata-")) / "lodestrata_package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((ROOT / "lodestrata").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def give_back() -> None:
    """Returns what a finished task has freed to the system: idle workers live on beside the next stage."""
    import ctypes

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for mapInArrow, giving memory back when its rows end."""

    def tidied(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied
