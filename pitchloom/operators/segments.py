"""Clip and segment windows over recordings, and the frames inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import explode_range, join_summary, spread

# Fixed values, in seconds: sliding clips.
CLIP_S, CLIP_HOP_S, MIN_CLIP_S = 30.0, 10.0, 20.0
# Fixed values, in seconds: long inputs and their segments.
LONG_S, SEGMENT_S, MIN_SEGMENT_S = 180.0, 90.0, 30.0
# Seconds of clip starts that share a shuffle partition key.
TILE_S = 600.0


def clip_count(
    duration: Column, hop: float = CLIP_HOP_S, min_clip: float = MIN_CLIP_S
) -> Column:
    return F.when(duration >= min_clip, F.floor((duration - min_clip) / hop) + 1).otherwise(0)


def clip_windows(
    recordings: DataFrame,
    clip: float = CLIP_S,
    hop: float = CLIP_HOP_S,
    min_clip: float = MIN_CLIP_S,
) -> DataFrame:
    """All clips of each recording: ``clip_start`` and ``clip_dur`` (the last may be short)."""
    dur = F.col("duration_s")
    rows = explode_range(recordings, clip_count(dur, hop, min_clip), "clip_idx")
    start = F.col("clip_idx") * hop
    return rows.withColumn("clip_start", start).withColumn("clip_dur", F.least(F.lit(clip), dur - start))


def clip_frames(
    frames: DataFrame,
    recordings: DataFrame,
    clip: float = CLIP_S,
    hop: float = CLIP_HOP_S,
    min_clip: float = MIN_CLIP_S,
    tile_s: float = TILE_S,
) -> DataFrame:
    """Frames of every clip, keyed by ``recording_id, tile, clip_start``.

    Each frame lies in up to ``clip / hop`` clips. Frames are shuffled once, by the
    tile their clips start in, with only the frames of the last clips of a tile
    sent twice; they are copied into clips after the shuffle. Grouping by all
    three columns keeps that partitioning. The other columns of ``recordings``
    come along.
    """
    k_lo = F.greatest(F.floor((F.col("ts") - clip) / hop) + 1, F.lit(0))
    k_hi = F.floor(F.col("ts") / hop)
    tile_of = lambda k: F.floor(k * hop / tile_s)
    tiled = frames.withColumn("tile", F.explode(F.sequence(tile_of(k_lo), tile_of(k_hi))))
    n = clip_count(F.col("duration_s"), hop, min_clip)
    tiles = explode_range(
        recordings.withColumn("_clips", n), tile_of(F.col("_clips") - 1) + 1, "tile"
    )
    # Clips of this tile that hold the frame and start before the last clip ends.
    per_tile = tile_s / hop
    first = F.greatest(k_lo, F.ceil(F.col("tile") * per_tile))
    last = F.least(k_hi, F.ceil((F.col("tile") + 1) * per_tile) - 1, F.col("_clips") - 1)
    tiled = spread(tiled, ["recording_id", "tile"])
    joined = join_summary(tiled, tiles, ["recording_id", "tile"]).filter(first <= last)
    start = F.col("_k") * hop
    return (
        joined.withColumn("_k", F.explode(F.sequence(first, last)))
        .withColumn("clip_start", start)
        .withColumn("clip_dur", F.least(F.lit(clip), F.col("duration_s") - start))
        .drop("_k", "_clips")
    )


CLIP_KEY = ("recording_id", "tile", "clip_start")


def quarter_segments(
    recordings: DataFrame, integer: bool = False, duration: str = "duration_s"
) -> DataFrame:
    """Three 90 s segments at the quarter points of a long input, else the whole.

    ``integer`` is the catalogue rule: whole-second quarters, no shortening.
    """
    dur = F.col(duration)
    quarter = F.floor(dur / 4) if integer else dur / 4

    def seg(i: int) -> Column:
        start = (quarter * i).cast("double")
        over = start + SEGMENT_S > dur
        length = F.when(over, F.greatest(F.lit(MIN_SEGMENT_S), dur - start)).otherwise(SEGMENT_S)
        return F.struct(
            F.lit(i).alias("seg_idx"),
            start.alias("seg_start"),
            (F.lit(SEGMENT_S) if integer else length).cast("double").alias("seg_dur"),
        )

    whole = F.struct(
        F.lit(0).alias("seg_idx"),
        F.lit(0.0).alias("seg_start"),
        dur.cast("double").alias("seg_dur"),
    )
    long = dur > LONG_S
    segs = F.when(long, F.array(seg(1), seg(2), seg(3))).otherwise(F.array(whole))
    return recordings.select("*", F.inline(segs))


def anchor_window(duration: Column) -> Column:
    """Start of the centred 180 s window."""
    return F.greatest(F.lit(0.0), (duration - LONG_S) / 2)


def window_frames(frames: DataFrame, windows: DataFrame, tile_s: float = LONG_S) -> DataFrame:
    """Frames inside ``[win_start, win_start + win_dur)``, per window.

    Both sides meet on ``(recording, tile)``, so a long recording is spread over
    its tiles and frames outside every window find no partner.
    """
    end = F.col("win_start") + F.col("win_dur")
    tiles = windows.withColumn(
        "tile", F.explode(F.sequence(F.floor(F.col("win_start") / tile_s), F.floor(end / tile_s)))
    )
    return (
        frames.withColumn("tile", F.floor(F.col("ts") / tile_s))
        .join(tiles, ["recording_id", "tile"])
        .filter((F.col("ts") >= F.col("win_start")) & (F.col("ts") < end))
        .drop("tile")
    )


def durations(frames: DataFrame, hop: float) -> DataFrame:
    """Recording length from its last frame."""
    return frames.groupBy("recording_id").agg((F.max("ts") + hop).alias("duration_s"))
