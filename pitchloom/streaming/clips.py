"""Sliding pitch-class counts on a stream of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import pitch
from ..operators.segments import CLIP_HOP_S, CLIP_S


def clip_bins(
    frames: DataFrame, clip: float = CLIP_S, hop: float = CLIP_HOP_S
) -> DataFrame:
    """Fan each voiced frame out to its clips: ``recording_id, clip_start, clip_end, bin``.

    ``frames`` carries ``recording_id, started_at, ts, f0_hz, tonic_hz`` with ``ts``
    in seconds from the start of the recording. Clips therefore start with the
    recording, not with the epoch, and none begins before it: frames at negative times
    lie in no clip.
    """
    first = F.greatest(F.floor((F.col("ts") - clip) / hop) + 1, F.lit(0))
    cents = pitch.cents_above(F.col("f0_hz"), F.col("tonic_hz"))
    end = F.unix_micros("started_at") + ((F.col("clip_start") + clip) * 1_000_000).cast("long")
    return (
        frames.filter(pitch.sounding(F.col("f0_hz")) & (F.col("ts") >= 0))
        .withColumn("_k", F.explode(F.sequence(first, F.floor(F.col("ts") / hop))))
        .withColumn("clip_start", F.col("_k") * hop)
        .select(
            "recording_id",
            "clip_start",
            F.timestamp_micros(end).alias("clip_end"),
            pitch.pitch_class_bin(cents).alias("bin"),
        )
    )


def clip_histogram(bins: DataFrame) -> DataFrame:
    return bins.groupBy("recording_id", "clip_start", "clip_end", "bin").agg(
        F.count(F.lit(1)).alias("n")
    )


def write_partial_counts(frames: DataFrame, path: str, checkpoint: str, clip: float = CLIP_S) -> StreamingQuery:
    """Write each batch's own counts to ``path/batch=<id>``.

    Nothing is kept between batches and no frame is too late, in whatever order files
    come; :func:`summed_counts` adds the parts up. A repeated batch overwrites its folder.
    """

    def write(rows: DataFrame, batch: int) -> None:
        clip_histogram(clip_bins(rows, clip)).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return (
        frames.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def write_closed_and_late(
    frames: DataFrame, path: str, checkpoint: str, lateness_s: float = 60.0, clip: float = CLIP_S
) -> StreamingQuery:
    """Counts per batch, with those that come after their clip was closed on the side.

    A clip is closed once another one ends ``clip + lateness_s`` seconds after it, in any
    earlier batch. Each batch writes its counts to ``path/counts/batch=<id>``, marked by
    ``late``, and then how far clips are closed to ``path/limits/batch=<id>``. A batch looks at
    the limits of earlier batches only, so a repeated one writes the same again. Nothing
    is dropped and no state is kept: see :func:`closed_counts` and :func:`late_counts`.
    """

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        limit = None
        if batch:
            limits = spark.read.schema("closed_us long, batch long").parquet(f"{path}/limits")
            limit = limits.filter(F.col("batch") < batch).agg(F.max("closed_us")).first()[0]
        end = F.unix_micros("clip_end")
        late = F.lit(False) if limit is None else end <= limit
        at = f"{path}/counts/batch={batch}"
        clip_histogram(clip_bins(rows, clip)).withColumn("late", late).write.mode("overwrite").parquet(at)
        reached = end - int((clip + lateness_s) * 1_000_000)
        seen = spark.read.parquet(at).agg(F.max(reached).alias("closed_us"))
        seen.select(F.greatest("closed_us", F.lit(limit).cast("long")).alias("closed_us")).write.mode("overwrite").parquet(
            f"{path}/limits/batch={batch}"
        )

    return (
        frames.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def closed_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counts of the clips closed by now, as they were when each was closed."""
    limit = spark.read.parquet(f"{path}/limits").agg(F.max("closed_us")).scalar()
    return summed_counts(spark.read.parquet(f"{path}/counts").filter((F.unix_micros("clip_end") <= limit) & ~F.col("late")))


def late_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counts that came after their clip was closed."""
    return summed_counts(spark.read.parquet(f"{path}/counts").filter("late"))


def summed_counts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("recording_id", "clip_start", "clip_end", "bin").agg(F.sum("n").alias("n"))


def stream_clip_histogram(frames: DataFrame, lateness_s: float = 60.0, clip: float = CLIP_S) -> DataFrame:
    """:func:`clip_histogram` on a stream, for append mode.

    The watermark runs on the clip's wall-clock end, which lies up to one clip
    ahead of its frames; that much is added to the allowed lateness. A closed
    clip leaves the state.
    """
    delay = f"{clip + lateness_s} seconds"
    return clip_histogram(clip_bins(frames, clip).withWatermark("clip_end", delay))
