"""Intermediate tables on shared storage, and row keys that survive a retry."""

from __future__ import annotations

import ctypes
import functools
import gc
import inspect
import tempfile
import weakref
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_folder

_shipped: weakref.WeakSet[SparkContext] = weakref.WeakSet()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, whose functions run in their Python workers.

    Spark hands the archive out, so it need not be installed there; once per context.
    """
    package = Path(__file__).resolve().parents[1]
    if spark.sparkContext in _shipped or not package.is_dir():
        return
    # Executors fetch the archive from the driver as their first tasks start, so it stays.
    archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(spark.sparkContext)


def let_go() -> None:
    """Give memory that a task has freed back to the machine: the worker goes on to other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy_driver(spark: SparkSession) -> None:
    """Drop the plans and results that earlier jobs left with the driver, before a job of many plans."""
    gc.collect()
    let_go()
    spark._jvm.System.gc()


def tidied(*caches: Callable) -> Callable:
    """For functions that run in tasks: at their end the caches are emptied and memory goes back."""

    def end() -> None:
        for cache in caches:
            cache.cache_clear()
        let_go()

    def wrap(run: Callable) -> Callable:
        @functools.wraps(run)
        def streamed(batches):
            try:
                yield from run(batches)
            finally:
                end()

        @functools.wraps(run)
        def whole(table):
            try:
                return run(table)
            finally:
                end()

        return streamed if inspect.isgeneratorfunction(run) else whole

    return wrap


class Stage:
    """Folder of one run of an operator; its tables cut the lineage.

    Tables are written by Spark to the folder that the cluster shares, so a lost
    executor costs no more than the tasks it was running.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        ship(spark)
        self.spark = spark
        self.folder = scratch_folder(spark, name)

    def keep(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_only(self, df: DataFrame, name: str) -> DataFrame:
        """:meth:`keep`, and what was shuffled for the table goes once it is written."""
        setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(setting, None)
        self.spark.conf.set(setting, "true")
        try:
            return self.keep(df, name)
        finally:
            if before is None:
                self.spark.conf.unset(setting)
            else:
                self.spark.conf.set(setting, before)

    def drop(self) -> None:
        """Delete the tables, once nothing that is still to be computed reads them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """A key per row, also of equal rows. Stable only once the rows are written."""
    return df.withColumn(name, F.monotonically_increasing_id())


def id_text(c: str):
    """An id as text, null as the empty text; what shares of rows are hashed from."""
    return F.coalesce(F.col(c).cast("string"), F.lit(""))
