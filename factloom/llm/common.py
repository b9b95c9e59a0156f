"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import remove, scratch, scratch_path, settings, shared_dir, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def finite(vector: Column) -> Column:
    """Not null, no null or non-finite component."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, unless their path has it already."""
    package, context = Path(__file__).resolve().parents[1], spark.sparkContext
    if context.applicationId in _shipped or str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='factloom-')}/{package.name}", "zip", root_dir=package.parent, base_dir=package.name))
    _shipped.add(context.applicationId)


def ready(spark: SparkSession, most: int = 4 << 20) -> None:
    """For operators that run Python in tasks: the package is there, and Arrow batches have about ``most`` bytes in this
    session, unless a limit of its own is set: texts differ in length by five orders of magnitude, so a batch of so many
    rows has no bound in memory."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in ("67108864b", "64MB", "64m"):
        spark.conf.set(key, str(most))


def release() -> None:
    """Freed memory that Arrow and the C library keep for later goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; after each batch and at the end its freed memory is released. Spark keeps workers for later
    tasks, more than run at once if a task needs two, and each would else hold the most that any task of it took."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                release()

        yield from run(each())
        release()

    return task
