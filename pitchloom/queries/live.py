"""Streaming queries, run to the end of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..session import scratch_folder
from ..streaming import clips, feedback as fb
from .registry import pc_bin_sql, query

# Seconds of recording time per event second: a month becomes 864 s.
PACE = 3000.0


def stream_table(spark, sf, name):
    """One of the tables as a file stream, be it one file or a folder of part files.

    A plain path must be a folder for a stream; a pattern may match either.
    """
    schema = fx.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def event_frames(events):
    """Events as frames in real time: each user a recording that starts with the month."""
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    at = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(start)
    rec = F.col("user_id").cast("string")
    return events.filter(F.col("event_type") != "error").select(
        rec.alias("recording_id"),
        start.alias("started_at"),
        (at / 1_000_000 / PACE).alias("ts"),
        (F.lit(60.0) + F.col("value")).alias("f0_hz"),
        fx.tonic_of(rec).alias("tonic_hz"),
    )


CLIP_COUNTS = f"""
  WITH f AS (SELECT CAST(user_id AS VARCHAR) AS recording_id, 60e0 + value AS f0_hz, 120e0 + user_id % 60 AS tonic_hz,
      (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000 / 3000e0 AS t FROM events WHERE event_type <> 'error'),
  c AS (SELECT *, unnest(range(greatest(floor((t - 30) / 10) + 1, 0)::BIGINT, floor(t / 10)::BIGINT + 1)) AS k FROM f)
  SELECT recording_id, k * 10e0 AS clip_start, {pc_bin_sql('1200e0 * log2(f0_hz / tonic_hz)')} AS bin, count(*) AS n
  FROM c GROUP BY ALL
"""


@query("str1_clip_histogram_batch", CLIP_COUNTS)
def clip_histogram_batch(spark, sf):
    out = clips.clip_histogram(clips.clip_bins(event_frames(fx.table(spark, sf, "events"))))
    return out.select("recording_id", "clip_start", "bin", "n")


@query("str1_clip_histogram_stream", CLIP_COUNTS)
def clip_histogram_stream(spark, sf):
    """The same counts from a stream: parts per batch, added up when read."""
    out = scratch_folder(spark, "clip-counts")
    frames = event_frames(stream_table(spark, sf, "events"))
    clips.write_partial_counts(frames, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    return clips.summed_counts(spark.read.parquet(f"{out}/data")).select("recording_id", "clip_start", "bin", "n")


LATENESS_S = 60.0


@query(
    "str1_clip_histogram_watermark",
    f"""WITH k AS ({CLIP_COUNTS}), e AS (SELECT max(clip_start) AS last FROM k)
    SELECT recording_id, clip_start, bin, n FROM k, e WHERE clip_start <= last - 30 - {LATENESS_S}""",
)
def clip_histogram_watermark(spark, sf):
    """Clips that are closed when the stream has been read, each written once.

    One run takes all files as one batch, so nothing is late. A clip is closed once
    another one ends a clip's length and the allowed lateness after it.
    """
    out = scratch_folder(spark, "closed-clips")
    counts = clips.stream_clip_histogram(event_frames(stream_table(spark, sf, "events")), LATENESS_S)
    run = (
        counts.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{out}/data")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    late = sum(int(s.get("numRowsDroppedByWatermark", 0)) for p in run.recentProgress for s in p["stateOperators"])
    if late:
        raise ValueError(f"{late} counts came after their clip was closed")
    return spark.read.parquet(f"{out}/data").select("recording_id", "clip_start", "bin", "n")


@query(
    "str1_late_clip_counts",
    f"""
  WITH f AS (SELECT CAST(user_id AS VARCHAR) AS recording_id, 60e0 + value AS f0_hz, 120e0 + user_id % 60 AS tonic_hz,
      (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000 / 3000e0 AS t FROM events WHERE event_type <> 'error'),
  c AS (SELECT *, unnest(range(greatest(floor((t - 30) / 10) + 1, 0)::BIGINT, floor(t / 10)::BIGINT + 1)) * 10e0 AS clip_start,
               t < 250 OR (t >= 500 AND t < 700) AS early FROM f),
  l AS (SELECT max(clip_start) FILTER (early) - {LATENESS_S} AS first, max(clip_start) - {LATENESS_S} AS last FROM c),
  m AS (SELECT *, NOT early AND clip_start + 30 <= first AS late FROM c, l)
  SELECT recording_id, clip_start, {pc_bin_sql('1200e0 * log2(f0_hz / tonic_hz)')} AS bin, late, count(*) AS n
  FROM m WHERE late OR clip_start + 30 <= last GROUP BY ALL""",
)
def late_clip_counts(spark, sf):
    """Two runs of one stream; the second brings frames of clips that the first has closed."""
    out = scratch_folder(spark, "late-clips")
    events = fx.table(spark, sf, "events")
    at = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.to_timestamp(F.lit("2024-01-01 00:00:00")))) / 1_000_000 / PACE
    early = (at < 250) | ((at >= 500) & (at < 700))
    for some in (early, ~early):
        events.filter(some).write.mode("append").parquet(f"{out}/events")
        frames = event_frames(spark.readStream.schema(events.schema).parquet(f"{out}/events"))
        clips.write_closed_and_late(frames, f"{out}/clips", f"{out}/checkpoint", LATENESS_S).awaitTermination()
    closed = clips.closed_counts(spark, f"{out}/clips").withColumn("late", F.lit(False))
    late = clips.late_counts(spark, f"{out}/clips").withColumn("late", F.lit(True))
    return closed.unionByName(late).select("recording_id", "clip_start", "bin", "late", "n")


FEEDBACK_SQL = """
  SELECT event_type AS actual_class, count(*) AS n_feedback, count(*) FILTER (value >= 20) AS n_corrections,
    count(*) FILTER (value >= 20) >= 50 AS retrain_ready FROM events GROUP BY 1
"""


def event_feedback(events):
    return events.select(
        F.col("event_type").alias("actual_class"), (F.col("value") < 20).alias("was_correct")
    )


@query("str2_feedback_stream", FEEDBACK_SQL)
def feedback_stream(spark, sf):
    """Running corrections per class; the last state of each class."""
    out = scratch_folder(spark, "corrections")
    run = fb.running_corrections(event_feedback(stream_table(spark, sf, "events")), f"{out}/data", f"{out}/checkpoint")
    run.awaitTermination()
    states = spark.read.parquet(f"{out}/data")
    return states.groupBy("actual_class").agg(
        F.max("n_feedback").alias("n_feedback"),
        F.max("n_corrections").alias("n_corrections"),
        F.max("retrain_ready").alias("retrain_ready"),
    )


@query("snk2_feedback_log", "SELECT event_type AS actual_class, value < 20 AS was_correct, count(*) AS n FROM events GROUP BY ALL")
def feedback_log(spark, sf):
    """Feedback appended by a stream, counted from the stored log."""
    out = scratch_folder(spark, "feedback")
    fb.append_log(event_feedback(stream_table(spark, sf, "events")), f"{out}/data", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/data").groupBy("actual_class", "was_correct").agg(F.count(F.lit(1)).alias("n"))
