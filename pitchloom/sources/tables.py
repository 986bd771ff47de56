"""Feature sets, feedback, reports and fitted models on storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import exists


def write_features(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet, partitioned by ``source`` so that a reader can leave sources out."""
    df.write.mode(mode).partitionBy("source").parquet(path)


def read_features(spark: SparkSession, path: str, *sources: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.filter(F.col("source").isin(*sources)) if sources else df


def union_sources(first: DataFrame, *more: DataFrame | None) -> DataFrame:
    """All feature sets that exist, one below the other, by column name."""
    out = first
    for df in more:
        if df is not None:
            out = out.unionByName(df)
    return out


def append_feedback(df: DataFrame, path: str) -> None:
    columns = ["predicted_class", "actual_class", "was_correct", "confidence", "audio_filename"]
    df.select(*columns).write.mode("append").parquet(path)


def append_once(df: DataFrame, path: str, batch: str, key: Sequence[str]) -> None:
    """Append the rows of ``batch`` whose ``key`` no other batch has; a repeated batch replaces itself.

    So a job may run again after any failure: each batch is one partition, published as a
    whole. Of rows with equal keys in the batch one is kept. Rows with a null in ``key`` have no
    counterpart in other batches and are all kept.
    """
    spark = df.sparkSession
    whole = df.dropna(subset=list(key))
    rows = whole.dropDuplicates(list(key))
    if exists(spark, path):
        others = spark.read.parquet(path).filter(F.col("batch").cast("string") != batch).select(*key)
        rows = rows.join(others, list(key), "left_anti")
    nameless = df.filter(" OR ".join(f"`{k}` IS NULL" for k in key))
    out = rows.unionByName(nameless).withColumn("batch", F.lit(batch))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str) -> None:
    """A table below ``path`` whose rows lie in ``buckets`` by ``key``, sorted within.

    Joins and aggregations by ``key`` of tables with the same number of buckets need no
    shuffle. A bucket is read by one task, so ``buckets`` follows the size of the largest
    table; a key must not hold more than a task can take.
    """
    df.write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)


def write_report(report: DataFrame, path: str) -> None:
    """A report of ``section, metric, key, value`` lines as one sorted JSON file set."""
    report.orderBy("section", "metric", "key").write.mode("overwrite").json(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
