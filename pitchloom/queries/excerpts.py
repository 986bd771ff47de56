"""Excerpt queries: tonic detection, clips, segments, excerpt features."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import histograms, order_stats, segments as seg, tonic
from ..functions import pitch
from ..plans import dataset, diagnostics, features
from .contours import FOLD_SQL, KEPT_SQL, kept_in_excerpts
from .registry import fold_sql, frames_sql, pc_bin_sql, q6, query, r6, swapped

PART = ["recording_id", "part"]

# Each piece works on the common table expressions of those before it, first of all on
# ``kept``: the frames that count, by ``recording_id, part``.
FOLD_TAIL = f""",
    folded AS (SELECT *, {FOLD_SQL} AS x FROM kept),
    hist AS (SELECT recording_id, part, CAST(least(floor((x - 60e0) / 0.3e0), 199) AS INTEGER) AS g, x FROM folded),
    exact AS (SELECT recording_id, part,
        g - CASE WHEN x < g * 0.3e0 + 60e0 THEN 1 ELSE 0 END
          + CASE WHEN g < 199 AND x >= (g + 1) * 0.3e0 + 60e0 THEN 1 ELSE 0 END AS bin FROM hist),
    counts AS (SELECT recording_id, part, bin, count(*) AS n FROM exact GROUP BY ALL)
"""
FOLD_HIST_SQL = KEPT_SQL + FOLD_TAIL


@query("agg3_folded_histogram", FOLD_HIST_SQL + "SELECT recording_id, part, CAST(bin AS INTEGER) AS bin, n FROM counts")
def folded_histogram(spark, sf):
    kept = kept_in_excerpts(spark, sf)
    return histograms.fixed_range_counts(kept, PART, pitch.fold_into(F.col("f0_hz")), 60.0, 120.0, 200)


SMOOTH_TAIL = """,
    spine AS (SELECT recording_id, part, CAST(b AS INTEGER) AS bin
              FROM (SELECT DISTINCT recording_id, part FROM counts), range(200) AS s(b)),
    filled AS (SELECT recording_id, part, bin, coalesce(n, 0) AS n FROM spine LEFT JOIN counts USING (recording_id, part, bin)),
    padded AS (SELECT * FROM filled
      UNION ALL SELECT recording_id, part, -1 - bin, n FROM filled WHERE bin IN (0, 1)
      UNION ALL SELECT recording_id, part, 399 - bin, n FROM filled WHERE bin IN (198, 199)),
    smoothed AS (SELECT * FROM (SELECT *, avg(n) OVER (PARTITION BY recording_id, part ORDER BY bin
      ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smoothed FROM padded) WHERE bin BETWEEN 0 AND 199)
"""
SMOOTH_SQL = FOLD_HIST_SQL + SMOOTH_TAIL


@query(
    "win3_smoothed_histogram",
    SMOOTH_SQL + f"SELECT recording_id, part, bin, {q6('smoothed')} AS smoothed FROM smoothed",
)
def smoothed_histogram(spark, sf):
    counts = histograms.fixed_range_counts(
        kept_in_excerpts(spark, sf), PART, pitch.fold_into(F.col("f0_hz")), 60.0, 120.0, 200
    )
    rows = histograms.dense(counts, PART, ["n"], 200)
    smoothed = rows.select(*PART, F.posexplode(tonic.smooth(F.col("n"), 200)).alias("bin", "smoothed"))
    return smoothed.withColumn("smoothed", r6("smoothed"))


CAND_TAIL = """,
    med AS (SELECT recording_id, part, median(f0_hz) AS m FROM kept GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY recording_id, part ORDER BY smoothed DESC, bin DESC) AS rank
               FROM smoothed WHERE smoothed > 0),
    base AS (SELECT *, ((bin * 0.3e0 + 60e0) + ((bin + 1) * 0.3e0 + 60e0)) / 2 AS c FROM ranked
             JOIN med USING (recording_id, part) WHERE rank <= 5),
    cands AS (SELECT recording_id, part, rank, bin, smoothed, m,
              c * pow(2e0, greatest(0, ceil(log2(m / c)) - 1)) AS hz FROM base)
"""
CAND_SQL = SMOOTH_SQL + CAND_TAIL


@query(
    "top3_tonic_candidates",
    CAND_SQL + f"""SELECT recording_id, part, CAST(rank AS INTEGER) AS rank, bin, {q6('hz')} AS hz,
      {q6('m')} AS median_hz FROM cands""",
)
def tonic_candidates(spark, sf):
    c = tonic.tonic_candidates(kept_in_excerpts(spark, sf), PART)
    return c.select(*PART, "rank", "bin", r6("hz").alias("hz"), r6("median_hz").alias("median_hz"))


SCORE_TAIL = f""",
    cand_bins AS (SELECT recording_id, part, rank, hz, {pc_bin_sql('1200e0 * log2(f0_hz / hz)')} AS bin, count(*) AS n
                  FROM kept JOIN cands USING (recording_id, part) GROUP BY ALL),
    scores AS (SELECT recording_id, part, rank, hz, CAST(sum(n * n) AS BIGINT) AS score FROM cand_bins GROUP BY ALL),
    found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, part ORDER BY score DESC, rank) AS best
              FROM scores) WHERE best = 1)
"""
SCORE_SQL = CAND_SQL + SCORE_TAIL
DETECT_TAIL = FOLD_TAIL + SMOOTH_TAIL + CAND_TAIL + SCORE_TAIL


@query(
    "jn10_agg7_candidate_scores",
    SCORE_SQL + f"SELECT recording_id, part, CAST(rank AS INTEGER) AS rank, {q6('hz')} AS hz, score FROM scores",
)
def candidate_scores(spark, sf):
    kept = kept_in_excerpts(spark, sf)
    s = tonic.score_candidates(kept, tonic.tonic_candidates(kept, PART), PART)
    return s.withColumn("hz", r6("hz"))


@query("top4_feat3_detected_tonic", SCORE_SQL + f"SELECT recording_id, part, {q6('hz')} AS tonic_hz FROM found")
def detected_tonic(spark, sf):
    return tonic.detect_tonic(kept_in_excerpts(spark, sf), PART).withColumn("tonic_hz", r6("tonic_hz"))


RECS_SQL = f"""WITH frames AS ({frames_sql(1.0)}),
    recs AS (SELECT recording_id, max(ts) + 1e0 AS duration_s, any_value(label) AS label,
      any_value(tonic_hz) AS expert FROM frames GROUP BY 1)"""
CLIPS_SQL = RECS_SQL + """,
    clips AS (SELECT recording_id, duration_s, label, expert, k * 10e0 AS clip_start,
                     least(30e0, duration_s - k * 10e0) AS clip_dur
              FROM (SELECT *, unnest(range(greatest(0, CAST(floor((duration_s - 20) / 10) AS BIGINT) + 1))) AS k FROM recs))
"""


def recs(spark, sf, hop=1.0):
    f = fx.frames(spark, sf, hop)
    return f, fx.recordings(f, hop)


@query("seg1_flt12_clip_windows", CLIPS_SQL + "SELECT recording_id, clip_start, clip_dur FROM clips")
def clip_windows(spark, sf):
    _, r = recs(spark, sf)
    return seg.clip_windows(r).select("recording_id", "clip_start", "clip_dur")


@query(
    "jn11_frames_per_clip",
    CLIPS_SQL + f"""SELECT recording_id, clip_start, count(*) AS n, count(*) FILTER (voiced) AS n_voiced,
      min(ts) AS first_ts, max(ts) AS last_ts, {q6('sum(f0_hz)')} AS total_hz
      FROM frames JOIN clips USING (recording_id) WHERE ts >= clip_start AND ts < clip_start + clip_dur GROUP BY ALL""",
)
def frames_per_clip(spark, sf):
    f, r = recs(spark, sf)
    return seg.clip_frames(f, r).groupBy(*seg.CLIP_KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("voiced").alias("n_voiced"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        r6(F.sum("f0_hz")).alias("total_hz"),
    ).drop("tile")


QUARTERS_SQL = f"""WITH frames AS ({frames_sql(4.0)}),
    recs AS (SELECT recording_id, max(ts) + 4e0 AS duration_s FROM frames GROUP BY 1),
    segs AS (SELECT recording_id, duration_s, i AS seg_idx, i * duration_s / 4 AS seg_start FROM recs, range(1, 4) s(i)
             WHERE duration_s > 180
             UNION ALL SELECT recording_id, duration_s, 0, 0e0 FROM recs WHERE duration_s <= 180)
"""


@query(
    "seg2_fn16_quarter_segments",
    QUARTERS_SQL + f"""SELECT recording_id, CAST(seg_idx AS INTEGER) AS seg_idx, {q6('seg_start')} AS seg_start,
      {q6('''CASE WHEN seg_idx = 0 THEN duration_s WHEN seg_start + 90 > duration_s
            THEN greatest(30e0, duration_s - seg_start) ELSE 90e0 END''')} AS seg_dur FROM segs""",
)
def quarter_segments(spark, sf):
    _, r = recs(spark, sf, 4.0)
    return seg.quarter_segments(r).select(
        "recording_id", "seg_idx", r6("seg_start").alias("seg_start"), r6("seg_dur").alias("seg_dur")
    )


@query(
    "seg3_catalogue_segments",
    """SELECT CAST(doc_id AS VARCHAR) AS id, CAST(i AS INTEGER) AS seg_idx, (n_chars // 4) * i::DOUBLE AS seg_start,
         90e0 AS seg_dur FROM documents, range(1, 4) s(i) WHERE n_chars > 180
       UNION ALL SELECT CAST(doc_id AS VARCHAR), 0, 0e0, CAST(n_chars AS DOUBLE) FROM documents WHERE n_chars <= 180""",
)
def catalogue_segments(spark, sf):
    return seg.quarter_segments(fx.catalogue(spark, sf), integer=True).select(
        "id", "seg_idx", "seg_start", "seg_dur"
    )


@query(
    "seg4_anchor_window",
    f"""WITH frames AS ({frames_sql(4.0)}), recs AS (SELECT recording_id, max(ts) + 4e0 AS d FROM frames GROUP BY 1)
    SELECT recording_id, greatest(0e0, (d - 180) / 2) AS win_start, count(*) AS n, sum(frame_idx)::BIGINT AS idx_sum
    FROM frames JOIN recs USING (recording_id)
    WHERE ts >= greatest(0e0, (d - 180) / 2) AND ts < greatest(0e0, (d - 180) / 2) + 180 GROUP BY ALL""",
)
def anchor_windows(spark, sf):
    f, r = recs(spark, sf, 4.0)
    w = r.select(
        "recording_id",
        seg.anchor_window(F.col("duration_s")).alias("win_start"),
        F.lit(seg.LONG_S).alias("win_dur"),
    )
    return seg.window_frames(f, w).groupBy("recording_id", "win_start").agg(
        F.count(F.lit(1)).alias("n"), F.sum("frame_idx").alias("idx_sum")
    )


# Settings under which the one-second grid of the fixture filters without emptying.
LOOSE = {"tslope": 600.0, "ttime": 2.0, "loose_tslope": 1200.0}


def excerpt_features_sql(kept: str, key: str, step: float = 1, strict: int = 600, loose: int = 1200, run: int = 2) -> str:
    """Features of kept frames that carry ``f0_hz`` and ``tonic``, grouped by ``key``."""
    return f""",
    c AS (SELECT *, 1200e0 * log2(f0_hz / tonic) AS cents FROM {kept}),
    g AS (SELECT *, abs(CASE WHEN lag(cents) OVER o IS NULL THEN (lead(cents) OVER o - cents) / {step}
                             WHEN lead(cents) OVER o IS NULL THEN (cents - lag(cents) OVER o) / {step}
                             ELSE (lead(cents) OVER o - lag(cents) OVER o) / ({step} * 2) END) AS slope,
                    row_number() OVER o AS i
          FROM c WINDOW o AS (PARTITION BY {key} ORDER BY ts)),
    s AS (SELECT *, coalesce(slope < {strict}, false) AS st, coalesce(slope < {loose}, false) AS loose FROM g),
    isl AS (SELECT *, i - row_number() OVER (PARTITION BY {key}, st ORDER BY i) AS island FROM s),
    h AS (SELECT *, st AND count(*) OVER (PARTITION BY {key}, st, island) >= {run} AS held FROM isl),
    fb AS (SELECT *, count(*) FILTER (held) OVER k AS nh, count(*) FILTER (loose) OVER k AS nl, count(*) OVER k AS na
           FROM h WINDOW k AS (PARTITION BY {key})),
    raw AS (SELECT {key}, any_value(tonic) AS tonic, {pc_bin_sql('cents')} AS bin, count(*) AS duration, any_value(na) AS n_duration,
             CASE WHEN any_value(nh) >= 10 THEN count(*) FILTER (held) ELSE count(*) END AS nyas,
             CASE WHEN any_value(nh) >= 10 THEN any_value(nh) ELSE any_value(na) END AS n_nyas,
             CASE WHEN any_value(nl) >= 10 THEN count(*) FILTER (loose) ELSE count(*) END AS stable,
             CASE WHEN any_value(nl) >= 10 THEN any_value(nl) ELSE any_value(na) END AS n_stable
            FROM fb GROUP BY {key}, {pc_bin_sql('cents')}),
    slots AS (
      SELECT {key}, tonic, bin AS slot, nyas / 10e0 / n_nyas AS v FROM raw UNION ALL
      SELECT {key}, tonic, 120 + bin, duration / 10e0 / n_duration FROM raw UNION ALL
      SELECT {key}, tonic, 240 + bin, stable / 10e0 / n_stable FROM raw)
"""


@query(
    "feat2_flt6_detected_features",
    SCORE_SQL
    + ", ready AS (SELECT kept.*, hz AS tonic FROM kept JOIN found USING (recording_id, part))"
    + excerpt_features_sql("ready", "recording_id, part")
    + f"SELECT recording_id, part, {q6('tonic')} AS tonic_hz, slot, {q6('v')} AS v FROM slots WHERE v > 0",
)
def detected_features(spark, sf):
    f = fx.frames(spark, sf, 1.0).withColumn("part", F.floor(F.col("ts") / 180.0).cast("int"))
    out = features.detected_features(f, PART, hop=1.0, **LOOSE)
    return (
        out.select(*PART, r6("tonic_hz").alias("tonic_hz"), F.posexplode("features").alias("slot", "v"))
        .filter("v > 0")
        .withColumn("v", r6("v"))
    )


# Features of the voiced frames of ``clips``.
INSIDE_SQL = """,
    inside AS (SELECT f.*, clip_start, clip_dur, expert FROM frames f JOIN clips USING (recording_id)
               WHERE ts >= clip_start AND ts < clip_start + clip_dur AND voiced),
    t AS (SELECT *, count(*) FILTER (voiced_prob > 0.3e0) OVER k AS sure, count(*) OVER k AS n_voiced
          FROM inside WINDOW k AS (PARTITION BY recording_id, clip_start)),
    kept AS (SELECT * FROM t WHERE CASE WHEN sure >= 15 THEN voiced_prob > 0.3e0 ELSE n_voiced >= 15 END),
    med AS (SELECT recording_id, clip_start, median(f0_hz) AS m FROM kept GROUP BY ALL),
    ready AS (SELECT *, expert * pow(2e0, ceil(log2(1.5e0 * m / expert)) - 1) AS tonic
              FROM kept JOIN med USING (recording_id, clip_start))
"""
CLIP_FEATURES_SQL = CLIPS_SQL + INSIDE_SQL


@query(
    "feat5_clip_features",
    CLIP_FEATURES_SQL
    + excerpt_features_sql("ready", "recording_id, clip_start, clip_dur, label, expert")
    + f"""SELECT recording_id, clip_start, clip_dur, label, expert AS expert_tonic_hz, {q6('tonic')} AS tonic_hz, slot,
          {q6('v')} AS v FROM slots WHERE v > 0""",
)
def clip_features(spark, sf):
    f, r = recs(spark, sf)
    out = features.clip_features(f, r, hop=1.0, min_voiced=15, **LOOSE)
    return (
        out.select(
            "recording_id",
            "clip_start",
            "clip_dur",
            "label",
            "expert_tonic_hz",
            r6("tonic_hz").alias("tonic_hz"),
            F.posexplode("features").alias("slot", "v"),
        )
        .filter("v > 0")
        .withColumn("v", r6("v"))
    )


@query(
    "agg19_clip_job_accounting",
    CLIPS_SQL + """,
    per_clip AS (SELECT recording_id, clip_start, count(*) FILTER (voiced AND voiced_prob > 0.3e0) AS sure,
                   count(*) FILTER (voiced) AS n_voiced
            FROM frames JOIN clips USING (recording_id) WHERE ts >= clip_start AND ts < clip_start + clip_dur GROUP BY ALL)
    SELECT CASE WHEN n_voiced >= 15 THEN 'ok' ELSE 'skipped' END AS status,
           CASE WHEN n_voiced >= 15 THEN '' ELSE 'unvoiced' END AS reason, count(*) AS n
    FROM per_clip GROUP BY ALL
    UNION ALL SELECT 'skipped', 'too_short', count(*) FROM recs WHERE duration_s < 20 HAVING count(*) > 0""",
)
def clip_job_accounting(spark, sf):
    f, r = recs(spark, sf)
    return features.clip_accounting(f, r, min_voiced=15)


@query(
    "agg17_tonic_error_summary",
    SCORE_SQL + f""", err AS (
      SELECT abs({fold_sql('1200e0 * log2(hz / (120e0 + CAST(recording_id AS BIGINT) % 60)) + 600')} - 600) AS e FROM found),
    o AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS i, count(*) OVER () AS n FROM err)
    SELECT count(*) AS n, {q6('avg(e)')} AS mean_abs, {q6('max(e) FILTER (i = n // 2)')} AS median_abs, {q6('max(e)')} AS max_abs,
      count(*) FILTER (e <= 25) AS n_good, count(*) FILTER (e <= 50) AS n_ok, count(*) FILTER (e > 50) AS n_broken FROM o""",
)
def tonic_error_summary(spark, sf):
    found = tonic.detect_tonic(kept_in_excerpts(spark, sf), PART)
    diff = pitch.cents_between(F.col("tonic_hz"), fx.tonic_of(F.col("recording_id")))
    err = found.select(F.abs(pitch.nearest_pitch_class_diff(diff)).alias("error"))
    out = order_stats.error_summary(err, "error")
    return out.select("n", *[r6(c).alias(c) for c in ("mean_abs", "median_abs", "max_abs")], "n_good", "n_ok", "n_broken")


# The first 90 s of every recording on the one-second grid.
FIRST_SQL = swapped(SCORE_SQL, "FROM frames WHERE voiced)", "FROM frames WHERE voiced AND ts < 90)")


@query(
    "qa2_tonic_diagnostic",
    FIRST_SQL + f""", r AS (SELECT recording_id, any_value(label) AS label, any_value(tonic_hz) AS expert FROM frames GROUP BY 1),
    d AS (SELECT r.*, hz, 1200e0 * log2(hz / expert) AS err FROM r LEFT JOIN found USING (recording_id))
    SELECT recording_id, label, expert AS expert_tonic_hz, {q6('hz')} AS tonic_hz, {q6('err')} AS error_cents,
      CASE WHEN err IS NULL THEN 'error' WHEN abs(err) <= 25 THEN 'good' WHEN abs(err) <= 50 THEN 'ok' ELSE 'broken' END AS band
    FROM d""",
)
def tonic_diagnostic(spark, sf):
    """All recordings instead of a sample of five."""
    f, r = recs(spark, sf)
    out = diagnostics.tonic_diagnostic(f, r, groups=None)
    return out.withColumns({c: r6(c) for c in ("tonic_hz", "error_cents")})


# One clip per recording, from its thirtieth second on.
PREFLIGHT_SQL = RECS_SQL + ", clips AS (SELECT *, 30e0 AS clip_start, 30e0 AS clip_dur FROM recs)" + INSIDE_SQL


@query(
    "qa3_clip_preflight",
    PREFLIGHT_SQL
    + excerpt_features_sql("ready", "recording_id, expert")
    + f""", w AS (SELECT recording_id, any_value(tonic) AS tonic, any_value(expert) AS expert, slot // 120 AS c, count(*) FILTER (v > 0) AS nz,
                  max(v) AS pv, arg_min(slot % 120, (-v, slot)) AS pb FROM slots GROUP BY ALL),
    all_recs AS (SELECT DISTINCT recording_id FROM frames WHERE ts >= 30 AND ts < 60)
    SELECT recording_id, ['nyas', 'duration', 'stable'][c + 1] AS channel, {q6('tonic')} AS tonic_hz,
      {q6(fold_sql('1200e0 * log2(tonic / expert) + 600') + ' - 600')} AS tonic_diff, tonic IS NOT NULL AS passed,
      CAST(pb AS INTEGER) AS peak_bin, {q6('pv')} AS peak_value, CAST(nz AS INTEGER) AS nonzero_bins
    FROM all_recs LEFT JOIN w USING (recording_id)""",
)
def clip_preflight(spark, sf):
    f, r = recs(spark, sf)
    out = diagnostics.clip_preflight(f, r, hop=1.0, groups=None, min_voiced=15, **LOOSE)
    return out.select(
        "recording_id",
        "channel",
        r6("tonic_hz").alias("tonic_hz"),
        r6("tonic_diff").alias("tonic_diff"),
        "passed",
        "peak_bin",
        r6("peak_value").alias("peak_value"),
        "nonzero_bins",
    )


@query(
    "feat5_clip_dataset",
    CLIP_FEATURES_SQL
    + """SELECT recording_id, CAST(CAST(recording_id AS BIGINT) % 5 AS INTEGER) AS label,
           'id-' || CAST(recording_id AS BIGINT) % 5 AS class_id, 'class ' || CAST(recording_id AS BIGINT) % 5 AS class_name,
           'audio/' || recording_id || '.wav' AS audio_path, 'detected' AS method, 'clips' AS source, clip_start, clip_dur
    FROM ready WHERE CAST(recording_id AS BIGINT) % 5 <> 4 GROUP BY recording_id, clip_start, clip_dur""",
)
def clip_dataset(spark, sf):
    """The job with its checks: labels, class ids and files of the clips of known classes."""
    f, r = recs(spark, sf)
    k = F.col("recording_id").cast("long") % 5
    rec = r.select(
        "recording_id",
        "duration_s",
        F.concat(F.lit("class "), k).alias("class_name"),
        F.concat(F.lit("audio/"), "recording_id", F.lit(".wav")).alias("audio_path"),
    )
    # The list lacks one of the classes.
    classes = r.select(k.cast("int").alias("label")).distinct().filter("label <> 4").select(
        "label", F.concat(F.lit("class "), "label").alias("class_name"), F.concat(F.lit("id-"), "label").alias("class_id")
    )
    tonics = r.select("recording_id", F.col("expert_tonic_hz").alias("tonic_hz"))
    out = dataset.clip_dataset(f, rec, tonics, classes, hop=1.0, min_voiced=15, **LOOSE)
    return out.select("recording_id", "label", "class_id", "class_name", "audio_path", "method", "source", "clip_start", "clip_dur")
