"""Checks before a long run: tonic detection and clip features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pitch, vectors
from ..operators import contour, quality, ranking, tonic
from ..operators.histograms import BINS
from . import features

# Fixed values, in seconds: what the two checks look at.
DIAGNOSTIC_S = 90.0
PREFLIGHT_START_S, PREFLIGHT_S = 30.0, 30.0

KEY = ["recording_id"]


def sampled(frames: DataFrame, recordings: DataFrame, groups: int | None, seed: int = 42) -> DataFrame:
    """Frames of one recording from each of ``groups`` classes; all when ``None``."""
    if groups is None:
        return frames
    drawn = ranking.two_stage_sample(recordings, "label", "recording_id", groups, seed)
    return frames.join(drawn.select("recording_id"), "recording_id", "left_semi")


def tonic_diagnostic(
    frames: DataFrame,
    recordings: DataFrame,
    groups: int | None = 5,
    min_voiced: int = features.MIN_VOICED,
) -> DataFrame:
    """Detected against annotated tonic on the first 90 s of each recording.

    ``recordings`` carries ``recording_id, label, expert_tonic_hz``. Recordings
    with too little voice stay, with a null tonic and the band ``error``. The
    error is the plain difference in cents: a wrong octave counts.
    """
    start = sampled(frames, recordings, groups).filter(F.col("ts") < DIAGNOSTIC_S)
    found = tonic.detect_tonic(contour.confident_or_voiced(start, KEY, min_voiced), KEY)
    tried = start.select("recording_id").distinct()
    error = pitch.cents_between(F.col("tonic_hz"), F.col("expert_tonic_hz"))
    return (
        tried.join(recordings, "recording_id")
        .join(found, "recording_id", "left")
        .select(
            "recording_id",
            "label",
            "expert_tonic_hz",
            "tonic_hz",
            error.alias("error_cents"),
            F.coalesce(pitch.error_band(error), F.lit("error")).alias("band"),
        )
    )


def clip_preflight(
    frames: DataFrame,
    recordings: DataFrame,
    hop: float = features.HOP_S,
    groups: int | None = 5,
    min_voiced: int = features.MIN_VOICED,
    **options,
) -> DataFrame:
    """Channel report of the clip from 30 to 60 s of each recording, with its tonic.

    One row per recording and channel; ``passed`` is the verdict on the whole
    clip. Clips with too little voice give one row without channel that failed.
    """
    clip = sampled(frames, recordings, groups).filter(
        (F.col("ts") >= PREFLIGHT_START_S) & (F.col("ts") < PREFLIGHT_START_S + PREFLIGHT_S)
    )
    feats = features.detected_features(
        clip.join(recordings.select("recording_id", "expert_tonic_hz"), "recording_id"),
        KEY,
        hop,
        given="expert_tonic_hz",
        min_voiced=min_voiced,
        keep=["expert_tonic_hz"],
        **options,
    )
    used = pitch.cents_between(F.col("tonic_hz"), F.col("expert_tonic_hz"))
    report = quality.channel_report(
        quality.long_channels(
            feats.withColumn("tonic_diff", pitch.nearest_pitch_class_diff(used)),
            ["recording_id", "tonic_hz", "tonic_diff"],
            BINS,
            vectors.CHANNELS,
        )
    )
    verdict = report.groupBy("recording_id").agg(F.bool_and("passed").alias("passed"))
    return (
        clip.select("recording_id")
        .distinct()
        .join(verdict, "recording_id", "left")
        .withColumn("passed", F.coalesce("passed", F.lit(False)))
        .join(report.withColumnRenamed("passed", "channel_passed"), "recording_id", "left")
    )
