"""Feature vectors of whole recordings and of excerpts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pitch, vectors
from ..operators import contour, histograms, segments as seg, tonic
from ..operators.blocks import BLOCK_S

# Frame step of the tracked contour: 256 samples at 16 kHz.
HOP_S = 256 / 16000
# Voiced frames an excerpt needs, slope limit of its third channel.
MIN_VOICED = 30
LOOSE_TSLOPE = 3000.0


def annotated_counts(
    frames: DataFrame,
    tonics: DataFrame,
    segments: DataFrame,
    tslope: float = contour.TSLOPE,
    ttime: float = contour.TTIME,
    bins: int = histograms.BINS,
    block_s: float = BLOCK_S,
    block_rows: int | None = None,
) -> DataFrame:
    """Bin counts of the three channels per recording, before the support gates.

    Frames inside ``tani`` segments are cut out first; positions, neighbours and
    the mean step are those of the remaining frames. Columns ``nyas``,
    ``duration``, ``stable`` are dense count arrays, ``n_*`` their sums. Frames on no
    steady step want ``block_rows``, see :func:`contour.sweep_segments`.
    """
    swept = contour.sweep_segments(frames, segments, ["nyas", "tani"], block_s, block_rows)
    kept = (
        swept.filter(F.col("n_tani") == 0)
        .withColumn("nyas_hits", F.when(pitch.sounding(F.col("f0_hz")), F.col("n_nyas")).otherwise(0))
        .select("recording_id", "block", "ts", "f0_hz", "nyas_hits")
    )
    held = contour.annotate_stable(kept, tonics, tslope, ttime, also=["nyas_hits"])
    counts = histograms.bin_counts(
        contour.voiced_only(held),
        ["recording_id"],
        pitch.pitch_class_bin(F.col("cents"), bins),
        {
            "nyas": F.col("nyas_hits"),
            "duration": F.lit(1),
            "stable": F.col("held").cast("int"),
        },
    )
    return histograms.dense(counts, ["recording_id"], ["nyas", "duration", "stable"], bins)


def annotated_features(
    frames: DataFrame, tonics: DataFrame, segments: DataFrame, **options
) -> DataFrame:
    """360-value features per recording; a recording with a missing channel drops out.

    The first channel takes the frames in nyas segments, or the stably held ones
    when there are fewer than ten. Adds ``nyas_source`` to tell which.
    """
    least = histograms.MIN_VALUES
    counts = annotated_counts(frames, tonics, segments, **options)
    width = pitch.OCTAVE / options.get("bins", histograms.BINS)
    segment_based = F.col("n_nyas") >= least
    chosen = counts.withColumns(
        {
            "nyas_source": F.when(segment_based, "segments").otherwise("stable"),
            "nyas": F.when(segment_based, F.col("nyas")).otherwise(F.col("stable")),
            "n_nyas": F.when(segment_based, F.col("n_nyas")).otherwise(F.col("n_stable")),
        }
    )
    enough = (F.col("n_nyas") >= least) & (F.col("n_duration") >= least) & (F.col("n_stable") >= least)
    parts = [histograms.density(F.col(c), F.col(f"n_{c}"), width) for c in vectors.CHANNELS]
    return chosen.filter(enough).select(
        "recording_id",
        "nyas_source",
        *[F.col(f"n_{c}").cast("long").alias(f"n_{c}") for c in vectors.CHANNELS],
        F.concat(*parts).alias("features"),
    )


def resolve_tonic(
    voiced: DataFrame,
    key: Sequence[str],
    given: str | None,
    as_is: str | None = None,
    also: Sequence[str] = (),
) -> DataFrame:
    """Add ``tonic_hz``: detected, or the ``given`` column moved to the voice's octave.

    Where the boolean column ``as_is`` holds, the given value was detected on this
    very excerpt and stays. Excerpts whose given value is not positive drop out.
    ``also`` names the other columns that the caller goes on to use.
    """
    if given is None:
        found = tonic.detect_tonic(voiced, key, also)
        return voiced.join(found.hint("shuffle_hash"), list(key))
    hz = pitch.positive_or_null(F.col(given))
    folded = pitch.fold_override(hz, F.median("f0_hz").over(Window.partitionBy(*key)))
    settled = folded if as_is is None else F.when(F.col(as_is), hz).otherwise(folded)
    return voiced.withColumn("tonic_hz", settled).filter(F.col("tonic_hz").isNotNull())


def mark_excerpt(
    voiced: DataFrame,
    key: Sequence[str],
    hop: float = HOP_S,
    tslope: float = contour.TSLOPE,
    ttime: float = contour.TTIME,
    loose_tslope: float = LOOSE_TSLOPE,
) -> DataFrame:
    """Add ``cents``, ``held`` and ``loose`` to voiced frames with a ``tonic_hz``.

    Only voiced frames are present, so the slope reaches across silent gaps.
    """
    w = Window.partitionBy(*key).orderBy("ts")
    step: Column = F.lit(hop)
    steep = F.abs(
        contour.slope_of_hz(F.lag("f0_hz").over(w), F.col("f0_hz"), F.lead("f0_hz").over(w), step)
    )
    rows = (
        voiced.withColumn("cents", pitch.cents_above(F.col("f0_hz"), F.col("tonic_hz")))
        .withColumn("_slope", steep)
        .withColumn("stable", F.coalesce(F.col("_slope") < tslope, F.lit(False)))
        .withColumn("loose", F.coalesce(F.col("_slope") < loose_tslope, F.lit(False)))
        .drop("_slope")
    )
    return contour.excerpt_runs(rows, key, int(ttime / hop))


def detected_features(
    excerpts: DataFrame,
    key: Sequence[str],
    hop: float = HOP_S,
    given: str | None = None,
    as_is: str | None = None,
    min_voiced: int = MIN_VOICED,
    bins: int = histograms.BINS,
    keep: Sequence[str] = (),
    tslope: float = contour.TSLOPE,
    ttime: float = contour.TTIME,
    loose_tslope: float = LOOSE_TSLOPE,
) -> DataFrame:
    """360-value features per excerpt; too little voice gives no row.

    ``key`` bounds the frames of one excerpt. All windows and both aggregations
    share the partitioning of ``key``. The tonic is detected, or taken from the
    column ``given`` (see :func:`resolve_tonic`). ``keep`` names columns constant
    per excerpt that pass through.
    """
    also = [c for c in ("ts", given, as_is, *keep) if c is not None]
    used = dict.fromkeys([*key, "f0_hz", "voiced", "voiced_prob", *also])
    voiced = contour.confident_or_voiced(excerpts.select(*used), key, min_voiced)
    marked = mark_excerpt(
        resolve_tonic(voiced, key, given, as_is, also), key, hop, tslope, ttime, loose_tslope
    )
    return excerpt_vectors(marked, key, ["tonic_hz", *keep], bins)


def excerpt_vectors(marked: DataFrame, key: Sequence[str], carried: Sequence[str], bins: int = histograms.BINS) -> DataFrame:
    """The three channels of frames with ``cents``, ``held`` and ``loose``, one row per key.

    ``carried`` names columns constant per key.
    """
    names = ("nyas", "duration", "stable")
    counts = (
        marked.withColumn("bin", pitch.pitch_class_bin(F.col("cents"), bins))
        .groupBy(*key, "bin")
        .agg(
            F.count_if("held").alias("nyas"),
            F.count(F.lit(1)).alias("duration"),
            F.count_if("loose").alias("stable"),
            *[F.first(c).alias(c) for c in carried],
        )
    )
    out = histograms.dense(counts, key, names, bins, keep=carried)
    for c in ("nyas", "stable"):
        enough = F.col(f"n_{c}") >= histograms.MIN_VALUES
        out = out.withColumns(
            {
                c: F.when(enough, F.col(c)).otherwise(F.col("duration")),
                f"n_{c}": F.when(enough, F.col(f"n_{c}")).otherwise(F.col("n_duration")),
            }
        )
    width = pitch.OCTAVE / bins
    parts = [histograms.density(F.col(c), F.col(f"n_{c}"), width) for c in names]
    return out.select(
        *key, *carried, *[f"n_{c}" for c in names], F.concat(*parts).alias("features")
    )


def clip_features(
    frames: DataFrame,
    recordings: DataFrame,
    hop: float = HOP_S,
    min_voiced: int = MIN_VOICED,
    keep: Sequence[str] = ("label",),
    **options,
) -> DataFrame:
    """Features of all sliding clips, each with its recording's annotated tonic.

    ``recordings`` carries ``recording_id, duration_s, expert_tonic_hz`` and the
    columns in ``keep``.
    """
    clips = seg.clip_frames(frames, recordings)
    return detected_features(
        clips,
        list(seg.CLIP_KEY),
        hop,
        given="expert_tonic_hz",
        min_voiced=min_voiced,
        keep=["clip_dur", "expert_tonic_hz", *keep],
        **options,
    ).drop("tile")


def clip_accounting(
    frames: DataFrame,
    recordings: DataFrame,
    min_voiced: int = MIN_VOICED,
) -> DataFrame:
    """Outcome counts of the clip job: ``status, reason, n``.

    ``ok`` and ``skipped``/``unvoiced`` count clips; ``skipped``/``too_short``
    counts recordings without any clip; ``error`` counts recordings without a
    length. Outcomes are rows, not accumulators, so a retried task counts once.
    """
    tiers = contour.excerpt_status(
        seg.clip_frames(frames, recordings), list(seg.CLIP_KEY), min_voiced
    ).select("recording_id", "clip_start", F.col("status").alias("_tier"))
    silent = F.coalesce(F.col("_tier"), F.lit("rejected")) == "rejected"
    clips = (
        seg.clip_windows(recordings)
        .select("recording_id", "clip_start")
        .join(tiers, ["recording_id", "clip_start"], "left")
        .select(
            F.when(silent, "skipped").otherwise("ok").alias("status"),
            F.when(silent, "unvoiced").otherwise("").alias("reason"),
        )
    )
    lost = F.col("duration_s").isNull()
    whole = recordings.filter(lost | (seg.clip_count(F.col("duration_s")) == 0)).select(
        F.when(lost, "error").otherwise("skipped").alias("status"),
        F.when(lost, "no_duration").otherwise("too_short").alias("reason"),
    )
    return clips.unionByName(whole).groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"))
