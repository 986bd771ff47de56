"""Feedback as a stream: an append log and running corrections per class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.catalogue import feedback_rollup


def append_log(feedback: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append every event once; the file sink's log makes retries harmless."""
    return (
        feedback.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def running_corrections(
    feedback: DataFrame, path: str, checkpoint: str, threshold: int = 50
) -> StreamingQuery:
    """Write changed classes of each batch to ``path/batch=<id>``.

    State holds one row per class. A repeated batch overwrites its own folder.
    """

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return (
        feedback_rollup(feedback, threshold=threshold)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
