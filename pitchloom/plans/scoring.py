"""Batch scoring of recordings: segments, shared tonic, averaged probabilities."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pitch, text, vectors
from ..operators import contour, quality, segments as seg, tonic
from . import features, long_excerpts

Scorer = Callable[[DataFrame], DataFrame]

WINDOW_KEY = ("recording_id", "role", "seg_idx")


def scoring_windows(recordings: DataFrame) -> DataFrame:
    """Windows to extract: ``whole`` for short inputs, else ``anchor`` and three ``segment``.

    ``recordings`` carries ``recording_id, duration_s, override_hz``, with known durations.
    """
    segs = seg.quarter_segments(recordings)
    long = F.col("duration_s") > seg.LONG_S
    role = F.when(long, "segment").otherwise("whole")
    cols = ["recording_id", "override_hz", "role", "seg_idx", "win_start", "win_dur"]
    parts = segs.withColumns(
        {"role": role, "win_start": F.col("seg_start"), "win_dur": F.col("seg_dur")}
    ).select(*cols)
    anchors = recordings.filter(long).select(
        "recording_id",
        "override_hz",
        F.lit("anchor").alias("role"),
        F.lit(0).alias("seg_idx"),
        seg.anchor_window(F.col("duration_s")).alias("win_start"),
        F.lit(seg.LONG_S).alias("win_dur"),
    )
    return parts.unionByName(anchors)


def leading_tonics(in_windows: DataFrame, key: Sequence[str], min_voiced: int) -> DataFrame:
    """``recording_id, found_hz``, detected on the one leading excerpt of each recording.

    Recordings with a positive override need none; a leading excerpt without
    enough voice gives no row.
    """
    free = in_windows.filter(pitch.positive_or_null(F.col("override_hz")).isNull())
    voiced = contour.confident_or_voiced(free, key, min_voiced)
    return tonic.detect_tonic(voiced, key).select("recording_id", F.col("tonic_hz").alias("found_hz"))


KNOWN = "duration_s > 0"


def whole_features(
    frames: DataFrame, recordings: DataFrame, hop: float, min_voiced: int, block_rows: int, **options
) -> DataFrame:
    """Features of the recordings without a known duration, each as a whole and of any length."""
    lost = recordings.filter(f"NOT coalesce({KNOWN}, false)").groupBy("recording_id").agg(F.max("override_hz").alias("override_hz"))
    rows = frames.join(lost, "recording_id")
    return long_excerpts.long_features(rows, ["recording_id"], hop, "override_hz", min_voiced, block_rows=block_rows, **options)


def mean_probability(scored: DataFrame, key: Sequence[str], **keep: Column) -> DataFrame:
    return quality.mean_vector(scored, key, "probability", "probability", keep)


def score_recordings(
    frames: DataFrame,
    recordings: DataFrame,
    scorer: Scorer,
    hop: float = features.HOP_S,
    min_voiced: int = features.MIN_VOICED,
    block_rows: int = long_excerpts.BLOCK_ROWS,
    **options,
) -> DataFrame:
    """Class probabilities per recording, with ``status`` and the tonic to report.

    Long inputs average the probabilities of the segments that have enough voice,
    all above one shared tonic; when none has, the anchor window stands in
    (``fallback``). A recording that gives nothing is ``rejected``. One without a known
    duration (null, zero or negative) is scored as a whole, block by block.
    """
    in_windows = seg.window_frames(frames, scoring_windows(recordings.filter(KNOWN)))
    found = leading_tonics(in_windows.filter("role <> 'segment'"), WINDOW_KEY, min_voiced)
    override = pitch.positive_or_null(F.col("override_hz"))
    ready = in_windows.join(found, "recording_id", "left").withColumns(
        {
            "given_hz": F.coalesce(override, F.col("found_hz")),
            "as_is": (F.col("role") != "segment") & override.isNull(),
        }
    )
    feats = features.detected_features(
        ready,
        WINDOW_KEY,
        hop,
        given="given_hz",
        as_is="as_is",
        min_voiced=min_voiced,
        keep=["given_hz"],
        **options,
    )
    lost = whole_features(frames, recordings, hop, min_voiced, block_rows, **options)
    feats = feats.unionByName(lost.withColumns({"role": F.lit("whole"), "seg_idx": F.lit(0)}))
    done = mean_probability(
        _choose(scorer(feats)),
        ["recording_id"],
        tonic_hz=F.max("given_hz"),
        _role=F.max("role"),
    )
    status = (
        F.when(F.col("_role").isNull(), "rejected")
        .when(F.col("_role") == "anchor", "fallback")
        .otherwise("ok")
    )
    return (
        recordings.select("recording_id", "override_hz")
        .join(done, "recording_id", "left")
        .select(
            "recording_id",
            status.alias("status"),
            F.coalesce("n_vectors", F.lit(0).cast("long")).alias("n_segments"),
            "probability",
            "tonic_hz",
            F.coalesce(F.col("override_hz") > 0, F.lit(False)).alias("tonic_overridden"),
        )
    )


def _choose(scored: DataFrame) -> DataFrame:
    """Drop the anchor window where a real segment succeeded.

    At most four rows per recording meet in the window.
    """
    w = Window.partitionBy("recording_id")
    others = F.count_if(F.col("role") != "anchor").over(w)
    return (
        scored.withColumn("_others", others)
        .filter((F.col("role") != "anchor") | (F.col("_others") == 0))
        .drop("_others")
    )


def score_catalogue(
    frames: DataFrame,
    items: DataFrame,
    scorer: Scorer,
    hop: float = features.HOP_S,
    min_voiced: int = features.MIN_VOICED,
    block_rows: int = long_excerpts.BLOCK_ROWS,
    **options,
) -> DataFrame:
    """Like :func:`score_recordings` under the catalogue rules.

    Whole-second quarters; without an override the first segment with enough
    voice sets the tonic for the later ones. ``items`` carries ``recording_id,
    duration_s, override_hz``. Every item has a row: one whose segments all fail is
    ``rejected``, one without a known duration is taken as a whole.
    """
    key = ["recording_id", "seg_idx"]
    wins = seg.quarter_segments(items.filter(KNOWN), integer=True).select(
        "recording_id", "override_hz", "seg_idx",
        F.col("seg_start").alias("win_start"), F.col("seg_dur").alias("win_dur"),
    )
    inside = seg.window_frames(frames, wins)
    tiers = contour.excerpt_status(inside, key, min_voiced).filter("status <> 'rejected'")
    first = tiers.groupBy("recording_id").agg(F.min("seg_idx").alias("first_idx"))
    # The leading segment detects its own tonic; the others take that one.
    marked = inside.join(first, "recording_id").withColumn("leads", F.col("seg_idx") == F.col("first_idx"))
    found = leading_tonics(marked.filter("leads"), key, min_voiced)
    override = pitch.positive_or_null(F.col("override_hz"))
    ready = marked.join(found, "recording_id", "left").withColumns(
        {
            "given_hz": F.coalesce(override, F.col("found_hz")),
            "as_is": F.col("leads") & override.isNull(),
        }
    )
    feats = features.detected_features(
        ready,
        key,
        hop,
        given="given_hz",
        as_is="as_is",
        min_voiced=min_voiced,
        keep=["given_hz"],
        **options,
    )
    feats = feats.unionByName(whole_features(frames, items, hop, min_voiced, block_rows, **options).withColumn("seg_idx", F.lit(0)))
    done = mean_probability(
        scorer(feats),
        ["recording_id"],
        tonic_hz=F.max("given_hz"),
    )
    return (
        items.select("recording_id", "override_hz")
        .join(done, "recording_id", "left")
        .select(
            "recording_id",
            F.when(F.col("n_vectors").isNull(), "rejected").otherwise("ok").alias("status"),
            F.coalesce("n_vectors", F.lit(0).cast("long")).alias("n_segments"),
            "probability",
            "tonic_hz",
            F.coalesce(F.col("override_hz") > 0, F.lit(False)).alias("tonic_overridden"),
        )
    )


def present(scored: DataFrame, class_names: Sequence[str] | Column, k: int = 5) -> DataFrame:
    """The result as callers see it: top classes in percent, the tonic and its note.

    ``class_names`` is the class list, in label order.
    """
    names = (
        class_names
        if isinstance(class_names, Column)
        else F.array(*[F.lit(n) for n in class_names])
    )
    top = F.transform(
        vectors.top_k(F.col("probability"), k),
        lambda t: F.struct(
            F.element_at(names, t["bin"] + 1).alias("class_name"),
            text.percent(t["value"]).alias("confidence"),
        ),
    )
    return scored.withColumn("predictions", top).select(
        *[c for c in scored.columns if c not in ("probability", "tonic_hz")],
        F.try_element_at("predictions", F.lit(1))["class_name"].alias("top_class"),
        F.try_element_at("predictions", F.lit(1))["confidence"].alias("confidence"),
        "predictions",
        F.bround("tonic_hz", 2).alias("tonic_hz"),
        pitch.note_name(F.col("tonic_hz")).alias("tonic_note"),
    )
