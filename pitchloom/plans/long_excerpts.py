"""Features of excerpts of any length, such as inputs whose duration nobody knows.

The definitions are those of :func:`features.detected_features`. There, one task holds
an excerpt; here its frames lie in blocks of bounded size (:mod:`operators.depth`), and
everything that looks beyond a block is carried: counts, neighbours and run borders
through tables with one row per block, medians by a search over counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pitch
from ..operators import contour, histograms, order_stats, tonic
from ..operators.blocks import agg_reading, carry, join_summary
from ..operators.depth import equi_depth
from ..session import scratch_folder, stored
from . import features

BLOCK_ROWS = 131_072


def with_facts(rows: DataFrame, facts: DataFrame, key: Sequence[str]) -> DataFrame:
    """Inner join of one row per key to blocked rows, which stay where they are."""
    on = [*key, "block"]
    return join_summary(rows, rows.select(*on).distinct().join(facts, list(key)), on)


def enough_voice(frames: DataFrame, key: Sequence[str], min_voiced: int) -> DataFrame:
    """The frames that :func:`contour.confident_or_voiced` keeps."""
    tiers = contour.excerpt_status(frames, key, min_voiced).filter("status <> 'rejected'").select(*key, "status")
    rows = with_facts(frames.filter("voiced"), tiers, key)
    return rows.filter((F.col("status") == "voiced") | (F.col("voiced_prob") > 0.3)).drop("status")


def detect_tonic(voiced: DataFrame, medians: DataFrame, key: Sequence[str]) -> DataFrame:
    """``key, tonic_hz`` as :func:`tonic.detect_tonic` finds it.

    Frames travel as counts per bin; the few candidates of a key meet its frames block by block.
    """
    binned = voiced.withColumn("bin", pitch.edge_bin(pitch.fold_into(F.col("f0_hz")), tonic.FOLD_LO, tonic.FOLD_HI, tonic.FOLD_BINS))
    counts = binned.groupBy(*key, "bin").agg(F.count(F.lit(1)).alias("n")).join(medians, list(key))
    best = tonic.ranked_candidates(counts, key)
    offered = best.groupBy(*key).agg(F.collect_list(F.struct("rank", "hz")).alias("_offered"))
    rows = with_facts(voiced, offered, key).select(*key, "f0_hz", F.inline("_offered"))
    bins = pitch.pitch_class_bin(pitch.cents_above(F.col("f0_hz"), F.col("hz")), histograms.BINS)
    sums = rows.groupBy(*key, "rank", "hz", bins.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    scores = sums.groupBy(*key, "rank", "hz").agg(F.sum(F.col("n") * F.col("n")).alias("score"))
    return tonic.best_candidate(scores, key)


def mark(voiced: DataFrame, key: Sequence[str], hop: float, tslope: float, ttime: float, loose_tslope: float) -> DataFrame:
    """:func:`features.mark_excerpt` over blocks: ``cents``, ``held`` and ``loose``."""
    on = [*key, "block"]
    rows = voiced.withColumn("cents", pitch.cents_above(F.col("f0_hz"), F.col("tonic_hz")))
    at = F.struct("ts", "f0_hz")
    used = [c for c in rows.columns if c not in (*on, "ts", "f0_hz")]
    ends = agg_reading(rows, on, [F.count(F.lit(1)).alias("_n"), F.min(at).alias("_first"), F.max(at).alias("_last")], also=used)
    ends = carry(
        ends,
        key,
        "block",
        before={"_before": F.sum("_n"), "_prev": F.max("_last")},
        after={"_next": F.min("_first")},
        whole={"n_frames": F.sum("_n")},
    ).select(
        *on,
        "n_frames",
        F.coalesce("_before", F.lit(0)).alias("_before"),
        F.col("_prev.f0_hz").alias("_prev"),
        F.col("_next.f0_hz").alias("_next"),
    )
    w = Window.partitionBy(*on).orderBy("ts", "f0_hz")
    local = rows.withColumns({"_rn": F.row_number().over(w), "_lag": F.lag("f0_hz").over(w), "_lead": F.lead("f0_hz").over(w)})
    steep = F.abs(contour.slope_of_hz(F.coalesce("_lag", "_prev"), F.col("f0_hz"), F.coalesce("_lead", "_next"), F.lit(hop)))
    marked = join_summary(local, ends, on).withColumns(
        {
            "frame_idx": F.col("_rn") - 1 + F.col("_before"),
            "stable": F.coalesce(steep < tslope, F.lit(False)),
            "loose": F.coalesce(steep < loose_tslope, F.lit(False)),
        }
    )
    return contour.hold_runs(marked.drop("_rn", "_lag", "_lead", "_before", "_prev", "_next"), key, "block", F.lit(int(ttime / hop)), also=used)


def long_features(
    frames: DataFrame,
    key: Sequence[str],
    hop: float,
    override: str | None = None,
    min_voiced: int = features.MIN_VOICED,
    bins: int = histograms.BINS,
    tslope: float = contour.TSLOPE,
    ttime: float = contour.TTIME,
    loose_tslope: float = features.LOOSE_TSLOPE,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``key, tonic_hz, given_hz, n_*, features`` of excerpts of any length.

    ``frames`` carries ``ts, f0_hz, voiced, voiced_prob`` and, constant per key, the column
    ``override``: a positive value is moved to the voice's octave, otherwise the tonic is
    detected. Excerpts with too little voice give no row. No task holds more than
    ``block_rows`` frames of an excerpt.
    """
    given = pitch.positive_or_null(F.col(override)) if override else F.lit(None).cast("double")
    rows = frames.select(*key, "ts", "f0_hz", "voiced", "voiced_prob", given.alias("given"))
    rows = equi_depth(rows, key, [F.col("ts"), F.col("f0_hz")], block_rows)
    # Median, tonic, counts and runs all read these frames.
    folder = scratch_folder(frames.sparkSession, "excerpts")
    voiced = stored(enough_voice(rows, key, min_voiced), folder, "voiced")
    medians = order_stats.exact_median(voiced, key, "f0_hz").withColumnRenamed("median", "median_hz")
    wanted = voiced.groupBy(*key).agg(F.max("given").alias("given")).join(medians, list(key))
    found = detect_tonic(voiced.filter("given is null"), medians, key).withColumnRenamed("tonic_hz", "found")
    settled = wanted.join(found, list(key), "left").select(
        *key,
        F.coalesce(pitch.fold_override(F.col("given"), F.col("median_hz")), "found").alias("tonic_hz"),
        F.coalesce("given", "found").alias("given_hz"),
    )
    settled = stored(settled, folder, "tonics")
    ready = with_facts(voiced.select(*key, "block", "ts", "f0_hz"), settled.filter("tonic_hz is not null"), key)
    marked = mark(ready, key, hop, tslope, ttime, loose_tslope)
    return features.excerpt_vectors(marked, key, ["tonic_hz", "given_hz"], bins)

