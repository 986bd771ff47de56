"""Frame-level operators: filters, segment cover, slope and stable runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pitch
from ..session import scratch_folder, stored
from .blocks import BLOCK_S, agg_reading, carry, explode_range, join_summary, time_block
from .depth import equi_depth

# Largest slope in cents per second, shortest hold in seconds.
TSLOPE = 1500.0
TTIME = 0.1


def voiced_only(frames: DataFrame) -> DataFrame:
    return frames.filter(pitch.sounding(F.col("f0_hz")))


def confident_or_voiced(
    frames: DataFrame, key: Sequence[str], min_voiced: int = 30, min_prob: float = 0.3
) -> DataFrame:
    """Confident frames of each excerpt, or all voiced ones where those are few.

    Excerpts with fewer than ``min_voiced`` voiced frames are left out; see
    :func:`excerpt_status` for naming them. ``key`` must bound the frames per
    group, as clips and segments do.
    """
    sure = F.col("voiced") & (F.col("voiced_prob") > min_prob)
    # In the order that later windows over the excerpt want, so its frames are sorted once.
    w = Window.partitionBy(*key).orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        frames.filter("voiced")
        .withColumn("_sure", sure)
        .withColumns({"_n_sure": F.count_if("_sure").over(w), "_n_voiced": F.count(F.lit(1)).over(w)})
        .filter(
            F.when(F.col("_n_sure") >= min_voiced, F.col("_sure")).otherwise(
                F.col("_n_voiced") >= min_voiced
            )
        )
        .drop("_sure", "_n_sure", "_n_voiced")
    )


def excerpt_status(
    frames: DataFrame, key: Sequence[str], min_voiced: int = 30, min_prob: float = 0.3
) -> DataFrame:
    """One row per excerpt: ``confident``, ``voiced`` or ``rejected``.

    Counts only, so it holds for groups of any size.
    """
    sure = F.col("voiced") & (F.col("voiced_prob") > min_prob)
    counts = frames.groupBy(*key).agg(
        F.count_if(sure).alias("n_confident"), F.count_if("voiced").alias("n_voiced")
    )
    tier = (
        F.when(F.col("n_confident") >= min_voiced, "confident")
        .when(F.col("n_voiced") >= min_voiced, "voiced")
        .otherwise("rejected")
    )
    return counts.withColumn("status", tier)


def frame_step(frames: DataFrame, single: float = 0.0044) -> DataFrame:
    """``recording_id, n_frames, dt``: the mean step, ``single`` for one frame."""
    n = F.count(F.lit(1))
    dt = (F.max("ts") - F.min("ts")) / F.nullif(n - 1, F.lit(0))
    return frames.groupBy("recording_id").agg(
        n.alias("n_frames"), F.coalesce(dt, F.lit(single)).alias("dt")
    )


def hold_times(frames: DataFrame, last: float = 0.0) -> DataFrame:
    """Add ``hold_s``: seconds until the next frame, ``last`` for the final one.

    An optional true-duration weight for the profile; the default weight is
    constant. ``frames`` carries ``recording_id, block, ts``.
    """
    on = ["recording_id", "block"]
    starts = carry(
        frames.groupBy(*on).agg(F.min("ts").alias("_first")),
        ["recording_id"],
        "block",
        after={"_next": F.min("_first")},
    ).drop("_first")
    lead = F.lead("ts").over(Window.partitionBy(*on).orderBy("ts"))
    return (
        join_summary(frames.withColumn("_lead", lead), starts, on)
        .withColumn("hold_s", F.coalesce(F.coalesce("_lead", "_next") - F.col("ts"), F.lit(last)))
        .drop("_lead", "_next")
    )


def rms_normalise(
    df: DataFrame, key: Sequence[str], value: str, target: float = 0.1, floor: float = 1e-6
) -> DataFrame:
    """Scale ``value`` to a root mean square of ``target`` per excerpt; near silence stays."""
    rms = F.sqrt(F.avg(F.col(value) * F.col(value)).over(Window.partitionBy(*key)))
    loud = F.when(F.col("rms") > floor, F.col(value) * (target / F.col("rms"))).otherwise(F.col(value))
    return df.withColumn("rms", rms).withColumn(value, loud)


def with_recording_columns(frames: DataFrame, facts: DataFrame) -> DataFrame:
    """Inner join of one row per recording to frames that carry a ``block``.

    The facts meet the list of blocks first, so the frames of one recording are
    spread over its blocks instead of meeting in one task.
    """
    on = ["recording_id", "block"]
    per_block = frames.select(*on).distinct().join(facts, "recording_id")
    return join_summary(frames, per_block, on)


def sweep_segments(
    frames: DataFrame,
    segments: DataFrame,
    kinds: Sequence[str],
    block_s: float = BLOCK_S,
    block_rows: int | None = None,
) -> DataFrame:
    """Add ``n_<kind>``: how many closed segments ``[start_s, end_s]`` hold each frame.

    A sweep over the union of frames and segment ends instead of a range join:
    one shuffle and one sort by ``(recording, block, ts)``, linear in both sides
    however many segments overlap. A frame in two segments counts 2.

    Blocks are stretches of ``block_s`` seconds, which suits a steady frame step. With
    ``block_rows`` they hold that many frames and segment ends at most, however
    unevenly those lie in time, see :mod:`depth`.
    """
    if block_rows is not None:
        return _sweep_ranks(frames, segments, kinds, block_rows)
    rec = "recording_id"
    carried = [c for c in frames.columns if c not in (rec, "ts")]
    frame_rows = frames.select(
        rec,
        time_block(F.col("ts"), block_s).alias("block"),
        "ts",
        F.lit(1).alias("_ord"),
        *carried,
        *[F.lit(0).alias(f"_d_{k}") for k in kinds],
    )
    # Ordered so that a start comes before, and an end after, the frames at its time.
    first = time_block(F.col("start_s"), block_s)
    last = time_block(F.col("end_s"), block_s)
    real = segments.filter(F.col("kind").isin(*kinds) & (F.col("start_s") <= F.col("end_s")))
    edges = (
        explode_range(real.select(rec, "kind", "start_s", "end_s"), last - first + 1, "_i")
        .withColumn("block", first + F.col("_i"))
        .select(
            rec,
            "block",
            "kind",
            F.explode(
                F.array(
                    F.struct(
                        F.greatest(F.col("start_s"), F.col("block") * block_s).alias("ts"),
                        F.lit(0).alias("_ord"),
                        F.lit(1).alias("_d"),
                    ),
                    F.struct(
                        F.col("end_s").alias("ts"), F.lit(2).alias("_ord"), F.lit(-1).alias("_d")
                    ),
                )
            ).alias("e"),
        )
        # The end lies in the last block only; earlier blocks simply stay open.
        .filter((F.col("e._ord") == 0) | (time_block(F.col("e.ts"), block_s) == F.col("block")))
        .select(
            rec,
            "block",
            "e.ts",
            "e._ord",
            *[F.lit(None).cast(frames.schema[c].dataType).alias(c) for c in carried],
            *[F.when(F.col("kind") == k, F.col("e._d")).otherwise(0).alias(f"_d_{k}") for k in kinds],
        )
    )
    w = (
        Window.partitionBy(rec, "block")
        .orderBy("ts", "_ord")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        frame_rows.unionByName(edges)
        .withColumns({f"n_{k}": F.sum(f"_d_{k}").over(w) for k in kinds})
        .filter(F.col("_ord") == 1)
        .drop("_ord", *[f"_d_{k}" for k in kinds])
    )


def _sweep_ranks(frames: DataFrame, segments: DataFrame, kinds: Sequence[str], block_rows: int) -> DataFrame:
    """The sweep over blocks of bounded size; what is open at their start is carried."""
    rec, on = "recording_id", ["recording_id", "block"]
    carried = [c for c in frames.columns if c not in (rec, "ts", "block")]
    deltas = [f"_d_{k}" for k in kinds]
    frame_rows = frames.select(rec, "ts", F.lit(1).alias("_ord"), *carried, *[F.lit(0).alias(d) for d in deltas])
    real = segments.filter(F.col("kind").isin(*kinds) & (F.col("start_s") <= F.col("end_s")))
    ends = real.select(
        rec,
        "kind",
        F.inline(
            F.array(
                F.struct(F.col("start_s").alias("ts"), F.lit(0).alias("_ord"), F.lit(1).alias("_d")),
                F.struct(F.col("end_s").alias("ts"), F.lit(2).alias("_ord"), F.lit(-1).alias("_d")),
            )
        ),
    ).select(
        rec,
        "ts",
        "_ord",
        *[F.lit(None).cast(frames.schema[c].dataType).alias(c) for c in carried],
        *[F.when(F.col("kind") == k, F.col("_d")).otherwise(0).alias(d) for k, d in zip(kinds, deltas)],
    )
    order = ["ts", "_ord", *[c for c in ("f0_hz",) if c in carried]]
    rows = equi_depth(frame_rows.unionByName(ends), [rec], [F.col(c) for c in order], block_rows)
    # All that follows reads the blocks, which take a join for every pass that made them.
    rows = stored(rows, scratch_folder(frames.sparkSession, "sweep"), "rows")
    sums = agg_reading(rows, on, [F.sum(d).alias(d) for d in deltas], also=["ts", "_ord", *carried])
    opened = carry(sums, [rec], "block", before={f"_open{d}": F.sum(d) for d in deltas}).drop(*deltas)
    w = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = rows.withColumns({f"_in{d}": F.sum(d).over(w) for d in deltas}).filter(F.col("_ord") == 1)
    held = {f"n_{k}": F.col(f"_in{d}") + F.coalesce(f"_open{d}", F.lit(0)) for k, d in zip(kinds, deltas)}
    return join_summary(swept, opened, on).withColumns(held).select(*on, "ts", *carried, *held)


def slope(prev: Column, here: Column, following: Column, dt: Column) -> Column:
    """Gradient with a constant step: central inside, one-sided at the two ends."""
    step = F.nullif(dt, F.lit(0.0))
    inner = (following - prev) / (step * 2)
    return F.when(
        prev.isNotNull() & following.isNotNull(), inner
    ).when(following.isNotNull(), (following - here) / step).when(
        prev.isNotNull(), (here - prev) / step
    )


def slope_of_hz(prev: Column, here: Column, following: Column, dt: Column) -> Column:
    """:func:`slope` in cents of sounding frames, from the ratio of the two frequencies.

    No tonic comes in, and a step of whole octaves is exact: two logarithms above a tonic
    would differ from it by an ulp either way, next to a limit such as 600 cents a second.
    """
    prev, here, following = (F.when(hz > 0, hz) for hz in (prev, here, following))
    steps = prev.isNotNull().cast("int") + following.isNotNull().cast("int")
    rise = pitch.cents_between(F.coalesce(following, here), F.coalesce(prev, here))
    return rise / F.nullif(dt * steps, F.lit(0.0))


def min_run_frames(ttime: float, dt: Column) -> Column:
    """Whole frames in ``ttime``, truncated."""
    return F.floor(F.lit(ttime) / F.nullif(dt, F.lit(0.0))).cast("long")


def annotate_stable(
    frames: DataFrame,
    tonics: DataFrame,
    tslope: float = TSLOPE,
    ttime: float = TTIME,
    also: Sequence[str] = (),
) -> DataFrame:
    """Mark the stably held frames of whole recordings of any length.

    ``frames`` carries ``recording_id, block, ts, f0_hz``; silent frames stay in
    the grid with 0 cents, so the slope next to silence is large. Recordings
    without a tonic drop out. Adds ``frame_idx`` (renumbered), ``n_frames``,
    ``dt``, ``tonic_hz``, ``cents``, ``stable`` (voiced and slope below
    ``tslope``) and ``held`` (in a stable run of at least ``ttime``). ``also`` names
    the other columns of ``frames`` that the caller goes on to use.
    """
    rec, on = "recording_id", ["recording_id", "block"]
    voiced = pitch.sounding(F.col("f0_hz"))
    at = F.struct("ts", "f0_hz")
    # The joins below imply this filter on their side only; stated once, it is the
    # same in all branches and they share one shuffle.
    frames = frames.filter(F.col(rec).isNotNull() & F.col("block").isNotNull())

    # First pass over the blocks: position, the frame on either side, the step.
    edges = agg_reading(
        frames,
        on,
        [F.count(F.lit(1)).alias("_n"), F.min(at).alias("_first"), F.max(at).alias("_last")],
        also,
    )
    edges = carry(
        edges,
        [rec],
        "block",
        before={"_before": F.sum("_n"), "_prev": F.max("_last")},
        after={"_next": F.min("_first")},
        whole={
            "n_frames": F.sum("_n"),
            "_lo": F.min("_first.ts"),
            "_hi": F.max("_last.ts"),
        },
    )
    dt = F.when(
        F.col("n_frames") > 1, (F.col("_hi") - F.col("_lo")) / F.nullif(F.col("n_frames") - 1, F.lit(0))
    )
    edges = edges.join(tonics.select(rec, "tonic_hz"), rec).select(
        *on,
        "tonic_hz",
        "n_frames",
        dt.alias("dt"),
        F.coalesce("_before", F.lit(0)).alias("_before"),
        F.col("_prev.f0_hz").alias("_prev_f0"),
        F.col("_next.f0_hz").alias("_next_f0"),
    )
    w = Window.partitionBy(*on).orderBy("ts", "f0_hz")
    local = frames.withColumns(
        {
            "_rn": F.row_number().over(w),
            "_lag": F.lag("f0_hz").over(w),
            "_lead": F.lead("f0_hz").over(w),
        }
    )

    def cents(hz: Column) -> Column:
        return F.when(hz.isNotNull(), pitch.cents_or_zero(hz, F.col("tonic_hz")))

    steep = F.abs(
        slope(
            cents(F.coalesce("_lag", "_prev_f0")),
            F.col("cents"),
            cents(F.coalesce("_lead", "_next_f0")),
            F.col("dt"),
        )
    )
    marked = (
        join_summary(local, edges, on)
        .withColumn("frame_idx", F.col("_rn") - 1 + F.col("_before"))
        .withColumn("cents", cents(F.col("f0_hz")))
        .withColumn("stable", F.coalesce(voiced & (steep < tslope), F.lit(False)))
        .drop("_rn", "_lag", "_lead", "_before", "_prev_f0", "_next_f0")
    )
    return hold_runs(marked, [rec], "block", min_run_frames(ttime, F.col("dt")), also)


def hold_runs(
    frames: DataFrame, key: Sequence[str], block: str, min_run: Column, also: Sequence[str] = ()
) -> DataFrame:
    """Keep a stable frame when its run of stable frames is long enough.

    The run reaches from the last unstable frame before to the first one after;
    both cross block borders by a running maximum and minimum. ``frames`` carries
    ``frame_idx``, ``n_frames`` and ``stable``; adds ``held``.
    """
    on = [*key, block]
    gap = F.when(~F.col("stable"), F.col("frame_idx"))
    gaps = agg_reading(
        frames, on, [F.min(gap).alias("_g_first"), F.max(gap).alias("_g_last")], also
    )
    gaps = carry(
        gaps,
        key,
        block,
        before={"_g_before": F.max("_g_last")},
        after={"_g_after": F.min("_g_first")},
    ).drop("_g_first", "_g_last")
    fwd = (
        Window.partitionBy(*on)
        .orderBy("frame_idx")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rev = (
        Window.partitionBy(*on)
        .orderBy(F.col("frame_idx").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = frames.withColumn("_before", F.max(gap).over(fwd)).withColumn("_after", F.min(gap).over(rev))
    run = (
        F.coalesce("_after", "_g_after", "n_frames")
        - F.coalesce("_before", "_g_before", F.lit(-1))
        - 1
    )
    return (
        join_summary(rows, gaps, on)
        .withColumn("held", F.col("stable") & F.coalesce(run >= min_run, F.lit(False)))
        .drop("_before", "_after", "_g_before", "_g_after")
    )


def excerpt_runs(frames: DataFrame, key: Sequence[str], min_run: int) -> DataFrame:
    """:func:`hold_runs` for groups bounded by ``key`` (clips, segments).

    A frame is held when a stretch of ``min_run`` stable frames ends on it or on one of the
    ``min_run - 1`` frames behind it. Running counts tell, in the one order of ``ts``.
    """
    if min_run <= 1:
        return frames.withColumn("held", F.col("stable"))
    order = Window.partitionBy(*key).orderBy("ts")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.col("_stable") - F.coalesce(F.lag("_stable", min_run).over(order), F.lit(0)) == min_run
    ends = F.coalesce(F.lead("_ends", min_run - 1).over(order), F.max("_ends").over(every))
    return (
        frames.withColumn("_stable", F.count_if("stable").over(upto))
        .withColumn("_full", full)
        .withColumn("_ends", F.count_if("_full").over(upto))
        .withColumn("held", F.col("stable") & (ends > F.coalesce(F.lag("_ends").over(order), F.lit(0))))
        .drop("_stable", "_full", "_ends")
    )
