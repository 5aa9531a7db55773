"""Tables that a job writes below the cluster's shared checkpoint folder.

An operator that reads an intermediate result more than once writes it here:
the rows are then fixed (generated row ids included), their lineage is cut,
and a lost executor costs only the tasks that were running on it.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path

#: Bytes of an Arrow batch that a task hands to Python, unless the session names a number.
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside hand Python ``BATCH_BYTES`` at a time: long texts don't add up to large batches."""
    if spark.conf.get(_BATCH_CONF, None) is not None:
        yield
        return
    spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH_CONF)


def release() -> None:
    """Give back what a task held: its Python worker lives on and serves other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        return


def releasing(run: Callable) -> Callable:
    """``run`` (batches -> batches) that gives memory back at its task's end."""

    @functools.wraps(run)
    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return outer


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete ``path`` through the file system that holds it."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Workspace:
    """One operator run's folder; ``put`` writes and rereads a table."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = scratch_path(spark, name)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with small_batches(self.spark):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that no later step reads."""
        for name in names:
            delete_folder(self.spark, f"{self.root}/{name}")
