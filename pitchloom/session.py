"""Session settings the jobs are written for."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "pitchloom", **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``conf`` overrides single settings."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split a skewed join even where that costs a later aggregation a shuffle.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        # Frames fan out into clips after their shuffle, so small partitions are
        # worth a task earlier than by size alone.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
        # Recording the call site of every expression costs more than building it.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update(conf)
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder on storage that the driver and all executors share.

    Taken from ``spark.checkpoint.dir``, else the checkpoint folder of the context,
    else below the warehouse. Where none of them names a file system, the folder is
    a plain local path, which only a local master may use.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
        on_one_machine = spark.sparkContext.master.startswith("local")
        if not on_one_machine and (":" not in base or base.startswith("file:")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` written below ``folder`` and read again: what several branches read is computed once."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
