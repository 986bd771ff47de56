"""Frame-level queries: scalars, filters, segments, slope, runs, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import pitch
from ..operators import contour, histograms, order_stats
from ..operators.blocks import time_block
from ..plans import features
from .registry import fold_sql, frames_sql, pc_bin_sql, q6, query, r6

HOP = 0.25


def grid(spark, sf, hop=HOP):
    """Silent frames as 0 Hz, blocked for whole-recording operators."""
    f = fx.frames(spark, sf, hop, silent_zero=True)
    return f.withColumn("block", time_block(F.col("ts"), fx.block_seconds(hop)))


def stable_frames(spark, sf, ttime=0.5):
    return contour.annotate_stable(
        grid(spark, sf).select("recording_id", "block", "ts", "f0_hz"), fx.tonics(spark, sf), ttime=ttime
    )


STABLE_SQL = f"""
    WITH frames AS ({frames_sql(HOP, True)}),
    steps AS (
      SELECT *, CASE WHEN f0_hz > 0 THEN 1200e0 * log2(f0_hz / tonic_hz) ELSE 0e0 END AS cents,
             count(*) OVER r AS n_frames, (max(ts) OVER r - min(ts) OVER r) / nullif(count(*) OVER r - 1, 0) AS dt
      FROM frames WINDOW r AS (PARTITION BY recording_id)),
    slopes AS (
      SELECT *, abs(CASE WHEN lag(cents) OVER o IS NULL THEN (lead(cents) OVER o - cents) / dt
                         WHEN lead(cents) OVER o IS NULL THEN (cents - lag(cents) OVER o) / dt
                         ELSE (lead(cents) OVER o - lag(cents) OVER o) / (2 * dt) END) AS slope
      FROM steps WINDOW o AS (PARTITION BY recording_id ORDER BY frame_idx)),
    marked AS (SELECT *, coalesce(f0_hz > 0 AND slope < 1500, false) AS stable FROM slopes),
    islands AS (
      SELECT *, frame_idx - row_number() OVER (PARTITION BY recording_id, stable ORDER BY frame_idx) AS island
      FROM marked),
    held AS (
      SELECT *, stable AND count(*) OVER (PARTITION BY recording_id, stable, island)
                >= floor(0.5e0 / dt) AS held
      FROM islands)
"""


@query(
    "agg1_win2_stable_pitch_profile",
    STABLE_SQL
    + f""", bins AS (
      SELECT recording_id, {pc_bin_sql('cents')} AS bin, count(*) AS n FROM held WHERE held GROUP BY ALL)
    SELECT recording_id, bin, n, {q6('n / 10e0 / total')} AS density
    FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY recording_id) AS BIGINT) AS total FROM bins)
    WHERE total >= 10""",
)
def stable_profile(spark, sf):
    """Pitch-class profile of every recording from its stably held notes."""
    held = stable_frames(spark, sf).filter("held")
    prof = histograms.pitch_class_profile(held, ["recording_id"])
    return (
        prof.select("recording_id", "n_values", F.posexplode("density").alias("bin", "d"))
        .filter(F.col("d") > 0)
        .select(
            "recording_id",
            "bin",
            F.round(F.col("d") * 10 * F.col("n_values")).cast("long").alias("n"),
            r6("d").alias("density"),
        )
    )


def voiced_frames(spark, sf):
    """Voiced frames with their recording's tonic, as the scalar functions take them."""
    f = fx.frames(spark, sf, HOP).filter("voiced")
    return f.withColumn("tonic_hz", fx.tonic_of(F.col("recording_id")))


VOICED = f"WITH frames AS ({frames_sql(HOP)}), v AS (SELECT * FROM frames WHERE voiced)"
CENTS = "1200e0 * log2(f0_hz / tonic_hz)"


@query(
    "fn1_fn2_fn3_pitch_class_bins",
    VOICED + f""" SELECT recording_id, {pc_bin_sql(CENTS)} AS bin, count(*) AS n,
      {q6(f'avg({CENTS})')} AS mean_cents, {q6(f'avg({fold_sql(CENTS)})')} AS mean_folded FROM v GROUP BY ALL""",
)
def pitch_class_bins(spark, sf):
    cents = pitch.cents_above(F.col("f0_hz"), F.col("tonic_hz"))
    return (
        voiced_frames(spark, sf)
        .withColumn("cents", cents)
        .withColumn("bin", pitch.pitch_class_bin(F.col("cents")))
        .groupBy("recording_id", "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            r6(F.avg("cents")).alias("mean_cents"),
            r6(F.avg(pitch.octave_reduce(F.col("cents")))).alias("mean_folded"),
        )
    )


FOLD_SQL = """CASE WHEN f0_hz > 120 THEN f0_hz / pow(2e0, ceil(log2(f0_hz / 120e0)))
                   WHEN f0_hz < 60 THEN f0_hz * pow(2e0, ceil(log2(60e0 / f0_hz))) ELSE f0_hz END"""


@query(
    "fn4_fold_frequency",
    VOICED + f" SELECT recording_id, frame_idx, {q6(FOLD_SQL)} AS folded FROM v",
)
def fold_frequency(spark, sf):
    return voiced_frames(spark, sf).select(
        "recording_id", "frame_idx", r6(pitch.fold_into(F.col("f0_hz"))).alias("folded")
    )


@query(
    "fn5_lift_candidate",
    VOICED + f""", c AS (SELECT *, {FOLD_SQL} AS cand FROM v)
    SELECT recording_id, frame_idx,
      {q6('cand * pow(2e0, greatest(0, ceil(log2(f0_hz / cand)) - 1))')} AS lifted FROM c""",
)
def lift_candidate(spark, sf):
    folded = pitch.fold_into(F.col("f0_hz"))
    return (
        voiced_frames(spark, sf)
        .withColumn("cand", folded)
        .select(
            "recording_id",
            "frame_idx",
            r6(pitch.lift_towards(F.col("cand"), F.col("f0_hz"))).alias("lifted"),
        )
    )


@query(
    "agg4_fn6_median_and_folded_override",
    VOICED + f""", m AS (SELECT recording_id, any_value(tonic_hz) AS t, median(f0_hz) AS m FROM v GROUP BY 1)
    SELECT recording_id, {q6('m')} AS median_hz,
      {q6('t * pow(2e0, ceil(log2(1.5e0 * m / t)) - 1)')} AS tonic_hz FROM m""",
)
def median_and_override(spark, sf):
    """Exact median per whole recording, and a given tonic moved to its octave."""
    m = order_stats.exact_median(voiced_frames(spark, sf), ["recording_id"], "f0_hz")
    return m.select(
        "recording_id",
        r6("median").alias("median_hz"),
        r6(pitch.fold_override(fx.tonic_of(F.col("recording_id")), F.col("median"))).alias("tonic_hz"),
    )


def note_sql(hz: str) -> str:
    midi = f"(69 + 12 * log2({hz} / 440e0))"
    k = f"CAST(round_even({midi}, 0) AS BIGINT)"
    off = f"CAST(round_even(({midi} - {k}) * 100, 0) AS BIGINT)"
    return f"""(['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][{k} % 12 + 1] || ({k} // 12 - 1)
      || CASE WHEN abs({off}) >= 3 THEN printf(' (%+d¢)', {off}) ELSE '' END)"""


@query("fn7_note_name", VOICED + f"SELECT {note_sql('f0_hz')} AS note, count(*) AS n FROM v GROUP BY 1")
def note_names(spark, sf):
    f = voiced_frames(spark, sf)
    return f.groupBy(pitch.note_name(F.col("f0_hz")).alias("note")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "fn8_chromatic_choices",
    VOICED + f""", m AS (SELECT CAST(round_even(69 + 12 * log2(f0_hz / 440e0), 0) AS INTEGER) AS midi FROM v)
    SELECT midi, {q6('440e0 * pow(2e0, (midi - 69) / 12e0)')} AS hz, count(*) AS n
    FROM m WHERE midi BETWEEN 36 AND 71 GROUP BY ALL""",
)
def chromatic_choices(spark, sf):
    """Frames per selectable tonic (C2 to B4) that they are nearest to."""
    midi = F.bround(F.lit(69.0) + 12 * F.log2(F.col("f0_hz") / 440.0), 0).cast("int")
    return (
        voiced_frames(spark, sf)
        .select(midi.alias("midi"))
        .filter(F.col("midi").between(36, 71))
        .groupBy("midi")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("hz", r6(pitch.midi_to_hz(F.col("midi"))))
    )


@query(
    "fn9_fn10_fn11_error_bands",
    VOICED + f""", e AS (SELECT recording_id, {CENTS} AS diff FROM v),
    w AS (SELECT recording_id, {fold_sql('diff + 600')} - 600 AS near FROM e)
    SELECT recording_id,
      CASE WHEN abs(near) <= 25 THEN 'good' WHEN abs(near) <= 50 THEN 'ok' ELSE 'broken' END AS band,
      count(*) AS n, {q6('sum(near)')} AS total FROM w GROUP BY ALL""",
)
def error_bands(spark, sf):
    diff = pitch.cents_between(F.col("f0_hz"), F.col("tonic_hz"))
    return (
        voiced_frames(spark, sf)
        .withColumn("near", pitch.nearest_pitch_class_diff(diff))
        .groupBy("recording_id", pitch.error_band(F.col("near")).alias("band"))
        .agg(F.count(F.lit(1)).alias("n"), r6(F.sum("near")).alias("total"))
    )


@query(
    "flt2_excerpt_tiers",
    f"""WITH frames AS ({frames_sql(HOP)}), c AS (
      SELECT recording_id, count(*) FILTER (voiced AND voiced_prob > 0.3e0) AS n_confident,
             count(*) FILTER (voiced) AS n_voiced FROM frames GROUP BY 1)
    SELECT *, CASE WHEN n_confident >= 30 THEN 'confident' WHEN n_voiced >= 30 THEN 'voiced'
                   ELSE 'rejected' END AS status FROM c""",
)
def excerpt_tiers(spark, sf):
    return contour.excerpt_status(fx.frames(spark, sf, HOP), ["recording_id"])


def kept_in_excerpts(spark, sf, min_voiced=30):
    """Recordings cut into stretches of 180 s, each with its confident or voiced frames."""
    f = fx.frames(spark, sf, 1.0).withColumn("part", F.floor(F.col("ts") / 180.0).cast("int"))
    return contour.confident_or_voiced(f, ["recording_id", "part"], min_voiced)


KEPT_SQL = f"""
    WITH frames AS ({frames_sql(1.0)}),
    parts AS (SELECT *, CAST(floor(ts / 180e0) AS INTEGER) AS part FROM frames WHERE voiced),
    tiers AS (SELECT *, count(*) FILTER (voiced_prob > 0.3e0) OVER k AS sure, count(*) OVER k AS n_voiced
              FROM parts WINDOW k AS (PARTITION BY recording_id, part)),
    kept AS (SELECT * FROM tiers WHERE CASE WHEN sure >= 30 THEN voiced_prob > 0.3e0 ELSE n_voiced >= 30 END)
"""


@query(
    "flt2_confident_or_voiced",
    KEPT_SQL + f"""SELECT recording_id, part, count(*) AS n, {q6('sum(f0_hz)')} AS total_hz,
      min(frame_idx) AS first_idx FROM kept GROUP BY ALL""",
)
def confident_or_voiced(spark, sf):
    return kept_in_excerpts(spark, sf).groupBy("recording_id", "part").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("f0_hz")).alias("total_hz"), F.min("frame_idx").alias("first_idx")
    )


@query(
    "agg2_duration_weighted_profile",
    VOICED + f""", b AS (SELECT recording_id, {pc_bin_sql(CENTS)} AS bin, count(*) AS n FROM v GROUP BY ALL)
    SELECT * FROM (SELECT recording_id, bin, {q6('n / 10e0 / sum(n) OVER (PARTITION BY recording_id)')} AS density,
      CAST(sum(n) OVER (PARTITION BY recording_id) AS BIGINT) AS n_values FROM b) WHERE n_values >= 10""",
)
def duration_weighted(spark, sf):
    """Every voiced frame weighs the same step, which the density cancels."""
    f = voiced_frames(spark, sf).withColumn("cents", pitch.cents_above(F.col("f0_hz"), F.col("tonic_hz")))
    prof = histograms.pitch_class_profile(f, ["recording_id"], weight=F.lit(HOP))
    return (
        prof.select("recording_id", "n_values", F.posexplode("density").alias("bin", "density"))
        .filter("density > 0")
        .withColumn("density", r6("density"))
    )


@query(
    "agg2_hold_weighted_profile",
    f"""WITH frames AS ({frames_sql(HOP)}), k AS (SELECT * FROM frames WHERE event_type <> 'signup'),
    h AS (SELECT *, coalesce(lead(ts) OVER (PARTITION BY recording_id ORDER BY ts) - ts, {HOP}e0) AS hold FROM k),
    b AS (SELECT recording_id, {pc_bin_sql(CENTS)} AS bin, sum(hold) AS w, count(*) AS c FROM h WHERE voiced GROUP BY ALL)
    SELECT recording_id, bin, {q6('w / 10e0 / sum(w) OVER (PARTITION BY recording_id)')} AS density,
      CAST(sum(c) OVER (PARTITION BY recording_id) AS BIGINT) AS n_values FROM b""",
)
def hold_weighted(spark, sf):
    """Each voiced frame weighs the time until the next frame of its recording."""
    f = fx.frames(spark, sf, HOP).filter("event_type <> 'signup'")
    f = f.withColumn("block", time_block(F.col("ts"), fx.block_seconds(HOP)))
    held = contour.hold_times(f.select("recording_id", "block", "ts", "f0_hz", "voiced"), last=HOP).filter("voiced")
    cents = pitch.cents_above(F.col("f0_hz"), fx.tonic_of(F.col("recording_id")))
    prof = histograms.pitch_class_profile(
        held.withColumn("cents", cents), ["recording_id"], weight=F.col("hold_s")
    )
    return (
        prof.select("recording_id", "n_values", F.posexplode("density").alias("bin", "density"))
        .filter("density > 0")
        .withColumn("density", r6("density"))
    )


@query(
    "agg5_mean_frame_step",
    f"""WITH frames AS ({frames_sql(HOP)}), s AS (SELECT * FROM frames WHERE event_type <> 'signup')
    SELECT recording_id, count(*) AS n_frames,
      {q6('coalesce((max(ts) - min(ts)) / nullif(count(*) - 1, 0), 0.0044e0)')} AS dt FROM s GROUP BY 1""",
)
def mean_frame_step(spark, sf):
    f = fx.frames(spark, sf, HOP).filter(F.col("event_type") != "signup")
    return contour.frame_step(f).withColumn("dt", r6("dt"))


@query(
    "agg6_rms_normalise",
    f"""WITH frames AS ({frames_sql(1.0)}), p AS (
      SELECT *, f0_hz - 60 AS v, CAST(floor(ts / 30e0) AS INTEGER) AS part FROM frames),
    r AS (SELECT *, sqrt(avg(v * v) OVER (PARTITION BY recording_id, part)) AS rms FROM p)
    SELECT recording_id, frame_idx, {q6('rms')} AS rms,
      {q6('CASE WHEN rms > 1e-6 THEN v * (0.1e0 / rms) ELSE v END')} AS v FROM r""",
)
def rms_normalise(spark, sf):
    f = fx.frames(spark, sf, 1.0).select(
        "recording_id",
        "frame_idx",
        F.floor(F.col("ts") / 30.0).cast("int").alias("part"),
        (F.col("f0_hz") - 60).alias("v"),
    )
    out = contour.rms_normalise(f, ["recording_id", "part"], "v")
    return out.select("recording_id", "frame_idx", r6("rms").alias("rms"), r6("v").alias("v"))


def swept(spark, sf):
    f = fx.frames(spark, sf, HOP, silent_zero=True)
    segs = fx.segments(f)
    base = f.select("recording_id", "ts", "f0_hz", "frame_idx")
    return contour.sweep_segments(base, segs, ["nyas", "tani"], fx.block_seconds(HOP))


SEGS_SQL = f"""
    WITH frames AS ({frames_sql(HOP, True)}),
    nyas AS (SELECT recording_id AS r, ts AS s, ts + 1 AS e FROM frames WHERE event_type = 'purchase'),
    tani AS (SELECT recording_id AS r, ts AS s, ts + 0.5e0 AS e FROM frames WHERE event_type = 'signup'),
    kept AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY ts) - 1 AS i FROM frames f
             WHERE NOT EXISTS (SELECT 1 FROM tani WHERE r = recording_id AND ts >= s AND ts <= e))
"""


@query(
    "jn1_frames_with_tonic",
    f"""WITH frames AS ({frames_sql(HOP)})
    SELECT recording_id, any_value(tonic_hz) AS tonic_hz, count(*) AS n, {q6(f'avg({CENTS})')} AS mean_cents
    FROM frames WHERE tonic_hz <= 165 GROUP BY 1""",
)
def frames_with_tonic(spark, sf):
    """Recordings without a tonic (here: above 165 Hz) drop out."""
    f = fx.frames(spark, sf, HOP).withColumn("block", time_block(F.col("ts"), fx.block_seconds(HOP)))
    joined = contour.with_recording_columns(f, fx.tonics(spark, sf).filter("tonic_hz <= 165"))
    return joined.groupBy("recording_id").agg(
        F.first("tonic_hz").alias("tonic_hz"),
        F.count(F.lit(1)).alias("n"),
        r6(F.avg(pitch.cents_above(F.col("f0_hz"), F.col("tonic_hz")))).alias("mean_cents"),
    )


@query(
    "jn2_frames_in_nyas",
    SEGS_SQL + """SELECT recording_id, count(*) AS n_hits, count(DISTINCT ts) AS n_frames
      FROM frames JOIN nyas ON r = recording_id AND ts >= s AND ts <= e AND f0_hz > 0 GROUP BY 1""",
)
def frames_in_nyas(spark, sf):
    """A frame in two overlapping segments counts twice."""
    hit = swept(spark, sf).filter((F.col("f0_hz") > 0) & (F.col("n_nyas") > 0))
    return hit.groupBy("recording_id").agg(
        F.sum("n_nyas").alias("n_hits"), F.count(F.lit(1)).alias("n_frames")
    )


@query(
    "jn3_frames_outside_tani",
    SEGS_SQL + f"""SELECT recording_id, count(*) AS n, min(frame_idx) AS first_idx, max(frame_idx) AS last_idx,
      {q6('sum(f0_hz)')} AS total_hz FROM kept GROUP BY 1""",
)
def frames_outside_tani(spark, sf):
    kept = swept(spark, sf).filter("n_tani = 0")
    return kept.groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("frame_idx").alias("first_idx"),
        F.max("frame_idx").alias("last_idx"),
        r6(F.sum("f0_hz")).alias("total_hz"),
    )


@query(
    "win1_win2_held_frames",
    STABLE_SQL + f"""SELECT recording_id, frame_idx, {q6('cents')} AS cents, stable, held FROM held""",
)
def held_frames(spark, sf):
    """Slope-stable frames and those in long enough runs, frame by frame."""
    return stable_frames(spark, sf).select("recording_id", "frame_idx", r6("cents").alias("cents"), "stable", "held")


@query(
    "flt3_minimum_support",
    STABLE_SQL + """SELECT recording_id, count(*) AS n FROM held WHERE held GROUP BY 1 HAVING count(*) >= 10""",
)
def minimum_support(spark, sf):
    held = stable_frames(spark, sf).filter("held")
    return held.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 10")


FEAT1_SQL = SEGS_SQL + f""",
    steps AS (
      SELECT *, CASE WHEN f0_hz > 0 THEN {CENTS} ELSE 0e0 END AS cents,
             (max(ts) OVER r - min(ts) OVER r) / nullif(count(*) OVER r - 1, 0) AS dt
      FROM kept WINDOW r AS (PARTITION BY recording_id)),
    slopes AS (
      SELECT *, abs(CASE WHEN lag(cents) OVER o IS NULL THEN (lead(cents) OVER o - cents) / dt
                         WHEN lead(cents) OVER o IS NULL THEN (cents - lag(cents) OVER o) / dt
                         ELSE (lead(cents) OVER o - lag(cents) OVER o) / (2 * dt) END) AS slope
      FROM steps WINDOW o AS (PARTITION BY recording_id ORDER BY i)),
    marked AS (SELECT *, coalesce(f0_hz > 0 AND slope < 1500, false) AS stable FROM slopes),
    islands AS (SELECT *, i - row_number() OVER (PARTITION BY recording_id, stable ORDER BY i) AS island FROM marked),
    held AS (SELECT *, stable AND count(*) OVER (PARTITION BY recording_id, stable, island) >= floor(1.5e0 / dt) AS held
             FROM islands),
    hits AS (SELECT recording_id, i, count(*) AS hits FROM held JOIN nyas ON r = recording_id AND ts >= s AND ts <= e
             GROUP BY ALL),
    raw AS (
      SELECT recording_id, {pc_bin_sql('cents')} AS bin, sum(coalesce(hits, 0)) AS nyas, count(*) AS duration,
             count(*) FILTER (held) AS stable
      FROM held LEFT JOIN hits USING (recording_id, i) WHERE f0_hz > 0 GROUP BY ALL),
    sums AS (SELECT *, sum(nyas) OVER k AS n_nyas, sum(duration) OVER k AS n_duration, sum(stable) OVER k AS n_stable
             FROM raw WINDOW k AS (PARTITION BY recording_id)),
    chosen AS (SELECT recording_id, bin, duration, stable, n_duration, n_stable,
             CASE WHEN n_nyas >= 10 THEN 'segments' ELSE 'stable' END AS nyas_source,
             CASE WHEN n_nyas >= 10 THEN nyas ELSE stable END AS nyas,
             CASE WHEN n_nyas >= 10 THEN n_nyas ELSE n_stable END AS n_nyas FROM sums),
    complete AS (SELECT * FROM chosen WHERE n_nyas >= 10 AND n_duration >= 10 AND n_stable >= 10)
"""


def feat1(spark, sf):
    f = fx.frames(spark, sf, HOP, silent_zero=True)
    return features.annotated_features(
        f.select("recording_id", "ts", "f0_hz"),
        fx.tonics(spark, sf),
        fx.segments(f),
        ttime=1.5,
        block_s=fx.block_seconds(HOP),
    )


@query(
    "flt4_flt5_channel_sources",
    FEAT1_SQL + """SELECT DISTINCT recording_id, nyas_source, CAST(n_nyas AS BIGINT) AS n_nyas,
      CAST(n_duration AS BIGINT) AS n_duration, CAST(n_stable AS BIGINT) AS n_stable FROM complete""",
)
def channel_sources(spark, sf):
    """Recordings with all three channels, and where the first one comes from."""
    return feat1(spark, sf).drop("features")


@query(
    "feat1_annotated_features",
    FEAT1_SQL + f""", slots AS (
      SELECT recording_id, bin AS slot, nyas / 10e0 / n_nyas AS v FROM complete UNION ALL
      SELECT recording_id, 120 + bin, duration / 10e0 / n_duration FROM complete UNION ALL
      SELECT recording_id, 240 + bin, stable / 10e0 / n_stable FROM complete)
    SELECT recording_id, slot, {q6('v')} AS v FROM slots WHERE v > 0""",
)
def annotated_features(spark, sf):
    f = feat1(spark, sf).select("recording_id", F.posexplode("features").alias("slot", "v"))
    return f.filter("v > 0").withColumn("v", r6("v"))


# Frames at uneven times: all of every second day lie within a few milliseconds.
UNEVEN_SQL = """
    WITH t AS (SELECT *, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS us FROM events),
    frames AS (
      SELECT CAST(user_id % 5 AS VARCHAR) AS recording_id, event_id, event_type,
             CASE WHEN event_type <> 'error' THEN 60e0 + value ELSE 0e0 END AS f0_hz, 120e0 + user_id % 5 AS tonic_hz,
             (us // 86400000000) * 10 + (us % 86400000000) / 86400e6 * (CASE WHEN us // 86400000000 % 2 = 0 THEN 0.001e0 ELSE 8e0 END) AS ts
      FROM t),
    cut AS (SELECT recording_id AS r, ts AS s, ts + 0.01e0 AS e FROM frames WHERE event_type = 'signup'),
    nyas AS (SELECT recording_id AS r, ts AS s, ts + 0.3e0 AS e FROM frames WHERE event_type = 'purchase'),
    kept AS (SELECT * FROM frames WHERE NOT EXISTS (SELECT 1 FROM cut WHERE r = recording_id AND ts >= s AND ts <= e)),
    hits AS (SELECT event_id, count(*) AS n_nyas FROM kept JOIN nyas ON r = recording_id AND ts >= s AND ts <= e GROUP BY 1),
    steps AS (
      SELECT *, CASE WHEN f0_hz > 0 THEN 1200e0 * log2(f0_hz / tonic_hz) ELSE 0e0 END AS cents,
             row_number() OVER (PARTITION BY recording_id ORDER BY ts, f0_hz) - 1 AS frame_idx,
             (max(ts) OVER r - min(ts) OVER r) / nullif(count(*) OVER r - 1, 0) AS dt
      FROM kept WINDOW r AS (PARTITION BY recording_id)),
    slopes AS (
      SELECT *, abs(CASE WHEN lag(cents) OVER o IS NULL THEN (lead(cents) OVER o - cents) / dt
                         WHEN lead(cents) OVER o IS NULL THEN (cents - lag(cents) OVER o) / dt
                         ELSE (lead(cents) OVER o - lag(cents) OVER o) / (2 * dt) END) AS slope
      FROM steps WINDOW o AS (PARTITION BY recording_id ORDER BY frame_idx)),
    marked AS (SELECT *, coalesce(f0_hz > 0 AND slope < 6000, false) AS stable FROM slopes),
    islands AS (
      SELECT *, frame_idx - row_number() OVER (PARTITION BY recording_id, stable ORDER BY frame_idx) AS island FROM marked)
    SELECT recording_id, event_id, frame_idx, coalesce(n_nyas, 0) AS n_nyas, stable,
           stable AND count(*) OVER (PARTITION BY recording_id, stable, island) >= floor(0.3e0 / dt) AS held
    FROM islands LEFT JOIN hits USING (event_id)"""


@query("win1_win2_jn2_uneven_frames", UNEVEN_SQL)
def uneven_frames(spark, sf):
    """Cut, cover and hold of frames in bursts, in blocks of at most 128 frames and segment ends."""
    us = F.unix_micros(F.col("ts").cast("timestamp")) - 1_704_067_200_000_000
    number = F.col("user_id") % 5
    day, rest = F.floor(us / F.lit(86_400_000_000)), us % F.lit(86_400_000_000)
    at = day * 10 + rest / F.lit(86400e6) * F.when(day % 2 == 0, 0.001).otherwise(8.0)
    f = fx.table(spark, sf, "events").select(
        number.cast("string").alias("recording_id"),
        at.alias("ts"),
        F.when(F.col("event_type") != "error", F.lit(60.0) + F.col("value")).otherwise(0.0).alias("f0_hz"),
        "event_id",
        "event_type",
    )
    kind = F.when(F.col("event_type") == "purchase", "nyas").when(F.col("event_type") == "signup", "tani")
    segs = f.select("recording_id", kind.alias("kind"), F.col("ts").alias("start_s"), (F.col("ts") + F.when(kind == "nyas", 0.3).otherwise(0.01)).alias("end_s"))
    cover = contour.sweep_segments(f.drop("event_type"), segs.filter("kind is not null"), ["nyas", "tani"], block_rows=128)
    kept = cover.filter("n_tani = 0").select("recording_id", "block", "ts", "f0_hz", "event_id", "n_nyas")
    tonics = f.select("recording_id").distinct().withColumn("tonic_hz", (F.lit(120) + F.col("recording_id").cast("long")).cast("double"))
    held = contour.annotate_stable(kept, tonics, tslope=6000.0, ttime=0.3, also=["event_id", "n_nyas"])
    return held.select("recording_id", "event_id", "frame_idx", F.col("n_nyas").cast("long").alias("n_nyas"), "stable", "held")
