import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchloom.operators import contour, segments as seg, tonic
from pitchloom.operators.blocks import explode_range
from pitchloom.plans import diagnostics, features, scoring

from . import brute

KEY = ["recording_id"]


def tracked(spark, rows):
    return spark.createDataFrame(
        rows, "recording_id string, ts double, f0_hz double, voiced boolean, voiced_prob double"
    )


def singer(seed, n, hop=0.5, base=150.0, voiced=0.8, sure=0.7):
    """Frames around the degrees of a scale, with silence and unsure frames."""
    rng = np.random.default_rng(seed)
    degree = rng.choice([0, 200, 400, 500, 700, 900, 1100, 1200], n) + rng.normal(0, 12, n)
    hold = np.repeat(np.arange(0, n, 3), 3)[:n]
    hz = base * 2 ** (degree[hold] / 1200)
    on = rng.random(n) < voiced
    prob = np.where(rng.random(n) < sure, 0.9, 0.1)
    return [(float(i * hop), float(h), bool(o), float(p)) for i, (h, o, p) in enumerate(zip(hz, on, prob))]


def kept(rows, least=30):
    conf = [r for r in rows if r[2] and r[3] > 0.3]
    voiced = [r for r in rows if r[2]]
    if len(conf) >= least:
        return conf
    return voiced if len(voiced) >= least else None


@pytest.mark.parametrize(
    "sure, plain, want", [(30, 0, 30), (29, 0, 0), (29, 1, 30), (0, 30, 30), (0, 29, 0), (31, 10, 31)]
)
def test_confidence_tiers(spark, sure, plain, want):
    rows = [("r", float(i), 200.0, True, 0.31) for i in range(sure)]
    rows += [("r", 100.0 + i, 200.0, True, 0.3) for i in range(plain)] + [("r", 999.0, 200.0, False, 0.9)]
    df = tracked(spark, rows)
    assert contour.confident_or_voiced(df, KEY).count() == want
    status = contour.excerpt_status(df, KEY).first().status
    assert status == ("confident" if sure >= 30 else "voiced" if sure + plain >= 30 else "rejected")


@pytest.fixture(scope="module")
def singers():
    return {f"s{i}": singer(i, 300, base=b) for i, b in enumerate([98.0, 131.0, 150.0, 233.0, 61.0])}


def test_tonic_detection_against_numpy(spark, singers):
    rows = [(k, *r) for k, v in singers.items() for r in v if r[2]]
    got = {r.recording_id: r.tonic_hz for r in tonic.detect_tonic(tracked(spark, rows), KEY).collect()}
    for k, v in singers.items():
        assert got[k] == pytest.approx(brute.detect([r[1] for r in v if r[2]]), rel=1e-12), k
    # Doubling every frequency keeps the pitch class.
    octave = [(k, ts, 2 * hz, on, p) for k, ts, hz, on, p in rows]
    high = {r.recording_id: r.tonic_hz for r in tonic.detect_tonic(tracked(spark, octave), KEY).collect()}
    for k in got:
        assert (np.log2(high[k] / got[k]) + 1e-9) % 1 < 1e-6


def test_earlier_candidate_wins_ties(spark):
    df = spark.createDataFrame(
        [("r", 2, 70.0, 9), ("r", 1, 80.0, 9), ("r", 3, 90.0, 8)], "recording_id string, rank int, hz double, score long"
    )
    assert tonic.best_candidate(df, KEY).first().tonic_hz == 80.0


def test_detected_features_against_numpy(spark, singers):
    rows = [(k, *r) for k, v in singers.items() for r in v]
    opts = {"tslope": 900.0, "ttime": 1.0, "loose_tslope": 1500.0}
    out = features.detected_features(tracked(spark, rows), KEY, hop=0.5, **opts).collect()
    assert len(out) == len(singers)
    for r in out:
        hz = [x[1] for x in kept(singers[r.recording_id])]
        want = brute.detected(hz, brute.detect(hz), 0.5, 900.0, 1500.0, 1.0)
        assert np.allclose(r.features, want, atol=1e-12), r.recording_id


def recordings(spark, rows):
    return spark.createDataFrame(rows, "recording_id string, duration_s double, label int, expert_tonic_hz double")


@pytest.mark.parametrize("total", [19.99, 20.0, 29.0, 30.0, 39.9, 40.0, 125.0])
def test_clip_windows(spark, total):
    got = seg.clip_windows(recordings(spark, [("r", total, 0, 1.0)])).orderBy("clip_start").collect()
    assert [(r.clip_start, r.clip_dur) for r in got] == brute.clip_starts(total)


def test_explode_range_in_chunks(spark):
    df = spark.createDataFrame([("a", 10), ("b", 0), ("c", 4)], "k string, n int")
    got = explode_range(df, F.col("n"), "i", chunk=4).groupBy("k").agg(F.sort_array(F.collect_list("i")).alias("i"))
    assert {r.k: r.i for r in got.collect()} == {"a": list(range(10)), "c": list(range(4))}


@pytest.mark.parametrize("tile_s", [10.0, 40.0, 600.0])
def test_clip_frames_and_features(spark, tile_s):
    rows = {"long": singer(11, 190), "short": singer(12, 30), "edge": singer(13, 40)}
    frames = tracked(spark, [(k, *r) for k, v in rows.items() for r in v])
    rec = recordings(spark, [(k, len(v) * 0.5, 1, 147.0) for k, v in rows.items()])
    inside = seg.clip_frames(frames, rec, tile_s=tile_s)
    got = {(r.recording_id, r.clip_start): (r.n, r.d) for r in inside.groupBy("recording_id", "clip_start").agg(
        F.count("*").alias("n"), F.first("clip_dur").alias("d")).collect()}
    want = {
        (k, s): (sum(s <= r[0] < s + d for r in v), d)
        for k, v in rows.items()
        for s, d in brute.clip_starts(len(v) * 0.5)
    }
    assert got == want
    assert inside.groupBy("recording_id", "ts").count().agg(F.max("count")).first()[0] <= 3
    if tile_s != 600.0:
        return
    opts = {"tslope": 900.0, "ttime": 1.0, "loose_tslope": 1500.0}
    feats = features.clip_features(frames, rec, hop=0.5, min_voiced=20, **opts).collect()
    seen = {(r.recording_id, r.clip_start): np.array(r.features) for r in feats}
    for (k, s), (_, d) in want.items():
        clip = kept([r for r in rows[k] if s <= r[0] < s + d], 20)
        assert (clip is None) == ((k, s) not in seen)
        if clip is not None:
            hz = [r[1] for r in clip]
            t = brute.fold_override(147.0, float(np.median(hz)))
            assert np.allclose(seen[k, s], brute.detected(hz, t, 0.5, 900.0, 1500.0, 1.0), atol=1e-12)
    counts = {(r.status, r.reason): r.n for r in features.clip_accounting(frames, rec, min_voiced=20).collect()}
    assert counts[("ok", "")] == len(seen) and counts[("skipped", "too_short")] == 1


def test_quarter_segments(spark):
    rec = recordings(spark, [("s", 180.0, 0, 1.0), ("l", 200.0, 0, 1.0), ("x", 1000.0, 0, 1.0)])
    got = {}
    for r in seg.quarter_segments(rec).collect():
        got.setdefault(r.recording_id, []).append((r.seg_start, r.seg_dur))
    assert got["s"] == [(0.0, 180.0)]
    assert sorted(got["l"]) == [(50.0, 90.0), (100.0, 90.0), (150.0, 50.0)]
    assert sorted(got["x"]) == [(250.0, 90.0), (500.0, 90.0), (750.0, 90.0)]
    whole = seg.quarter_segments(spark.createDataFrame([(203,)], "duration_s long"), integer=True)
    assert sorted((r.seg_start, r.seg_dur) for r in whole.collect()) == [(50.0, 90.0), (100.0, 90.0), (150.0, 90.0)]


def as_probability(feats):
    """Stand-in scorer: the first five values of the second channel."""
    return feats.withColumn("probability", F.slice("features", 121, 120))


def expect_scores(rows, total, override, hop, least):
    """Brute-force statement of the multi-segment rule; probability and tonic."""
    cut = lambda a, d: kept([r for r in rows if a <= r[0] < a + d], least)

    def vector(clip, t):
        hz = [r[1] for r in clip]
        return brute.detected(hz, t, hop)[120:240]

    if total <= 180:
        clip = cut(0, total)
        if clip is None:
            return None
        hz = [r[1] for r in clip]
        t = brute.fold_override(override, float(np.median(hz))) if override else brute.detect(hz)
        return vector(clip, t), override or t
    middle = max(0.0, (total - 180) / 2)
    anchor = override
    if not anchor:
        lead = cut(middle, 180)
        if lead is None:
            return None
        anchor = brute.detect([r[1] for r in lead])
    parts = []
    for i in (1, 2, 3):
        a = i * total / 4
        clip = cut(a, 90 if a + 90 <= total else max(30.0, total - a))
        if clip is not None:
            parts.append(vector(clip, brute.fold_override(anchor, float(np.median([r[1] for r in clip])))))
    if not parts:
        clip = cut(middle, 180)
        if clip is None:
            return None
        parts = [vector(clip, anchor)]
    return np.mean(parts, axis=0), anchor


def test_recording_scores_against_brute_force(spark):
    hop, least = 2.0, 30
    quiet = [(t, hz, on and 60 <= t < 130, p) for t, hz, on, p in singer(25, 150, hop)]
    cases = {
        "whole": (singer(21, 80, hop), None),
        "whole_given": (singer(22, 80, hop), 75.0),
        "long": (singer(23, 300, hop), None),
        "long_given": (singer(24, 300, hop), 300.0),
        "thin": (singer(26, 300, hop, voiced=0.05), None),
        "middle_only": (quiet, None),
    }
    frames = tracked(spark, [(k, *r) for k, (v, _) in cases.items() for r in v])
    rec = spark.createDataFrame(
        [(k, len(v) * hop, o) for k, (v, o) in cases.items()], "recording_id string, duration_s double, override_hz double"
    )
    out = {r.recording_id: r for r in scoring.score_recordings(frames, rec, as_probability, hop=hop, min_voiced=least).collect()}
    assert set(out) == set(cases)
    for k, (v, o) in cases.items():
        want = expect_scores(v, len(v) * hop, o, hop, least)
        assert (want is None) == (out[k].status == "rejected"), k
        if want is not None:
            assert np.allclose(out[k].probability, want[0], atol=1e-12), k
            assert out[k].tonic_hz == pytest.approx(want[1], rel=1e-12), k
        assert out[k].tonic_overridden == bool(o)
    assert out["thin"].status == "rejected" and out["long"].n_segments == 3


def test_fallback_to_the_anchor_window(spark):
    # 55 voiced frames in the anchor (40 to 220 s), at most 43 in any segment.
    hop, least = 2.0, 50
    rows = [(t, hz, 40 <= t < 150, 0.9) for t, hz, _, _ in singer(31, 130, hop)]
    frames = tracked(spark, [("r", *r) for r in rows])
    rec = spark.createDataFrame([("r", 260.0, None)], "recording_id string, duration_s double, override_hz double")
    out = scoring.score_recordings(frames, rec, as_probability, hop=hop, min_voiced=least).first()
    want = expect_scores(rows, 260.0, None, hop, least)
    assert want is not None and out.status == "fallback" and out.n_segments == 1
    assert np.allclose(out.probability, want[0], atol=1e-12)


def test_catalogue_scores_take_the_first_good_segment(spark):
    hop = 2.0
    # Silent in the first segment (75 to 165 s), voiced later.
    rows = [(t, hz, on and t >= 165, p) for t, hz, on, p in singer(41, 150, hop)]
    frames = tracked(spark, [("r", *r) for r in rows] + [("g", *r) for r in singer(42, 150, hop)])
    rec = spark.createDataFrame(
        [("r", 300.0, None), ("g", 300.0, 99.0)], "recording_id string, duration_s double, override_hz double"
    )
    out = {r.recording_id: r for r in scoring.score_catalogue(frames, rec, as_probability, hop=hop, min_voiced=20).collect()}
    cut = [kept([r for r in rows if a <= r[0] < a + 90], 20) for a in (75, 150, 225)]
    assert cut[0] is None
    lead = brute.detect([r[1] for r in cut[1]])
    assert out["r"].tonic_hz == pytest.approx(lead, rel=1e-12) and out["r"].n_segments == 2
    later = [r[1] for r in cut[2]]
    parts = [
        brute.detected([r[1] for r in cut[1]], lead, hop)[120:240],
        brute.detected(later, brute.fold_override(lead, float(np.median(later))), hop)[120:240],
    ]
    assert np.allclose(out["r"].probability, np.mean(parts, axis=0), atol=1e-12)
    assert out["g"].tonic_hz == 99.0 and out["g"].tonic_overridden and out["g"].n_segments == 3


@pytest.mark.parametrize("score", [scoring.score_recordings, scoring.score_catalogue])
def test_unknown_durations_and_rejected_items(spark, score):
    """Null, zero and negative durations: the whole input, however long; nothing vanishes."""
    hop, long, short = 2.0, singer(51, 150, 2.0), singer(52, 40, 2.0)
    silent = [(t, hz, False, 0.0) for t, hz, _, _ in short]
    cases = {"null": (long, None), "zero": (long, 0.0), "minus": (short, -1.0), "silent": (silent, 80.0), "mute": (silent, None), "none": ([], None), "known": (short, 80.0)}
    frames = tracked(spark, [(k, *r) for k, (v, _) in cases.items() for r in v])
    rec = spark.createDataFrame([(k, d, None) for k, (_, d) in cases.items()], "recording_id string, duration_s double, override_hz double")
    out = {r.recording_id: r for r in score(frames, rec, as_probability, hop=hop, min_voiced=20).collect()}
    assert set(out) == set(cases)
    for k, (rows, _) in cases.items():
        voiced = kept(rows, 20) if rows else None
        assert out[k].status == ("rejected" if voiced is None else "ok"), k
        if voiced is None:
            assert out[k].n_segments == 0 and out[k].probability is None
            continue
        hz = [r[1] for r in voiced]
        tonic = brute.detect(hz)
        assert out[k].n_segments == 1 and out[k].tonic_hz == pytest.approx(tonic, rel=1e-12)
        want = brute.detected(hz, tonic, hop)[120:240]
        assert np.allclose(out[k].probability, want, atol=1e-12), k


def test_presentation(spark):
    df = spark.createDataFrame(
        [("a", [0.1, 0.845, 0.055], 138.591, False), ("b", None, None, False)],
        "recording_id string, probability array<double>, tonic_hz double, tonic_overridden boolean",
    )
    a, b = scoring.present(df, ["x", "y", "z"], k=2).orderBy("recording_id").collect()
    assert (a.top_class, a.confidence, a.tonic_hz, a.tonic_note) == ("y", 84.5, 138.59, "C#3")
    assert [(p.class_name, p.confidence) for p in a.predictions] == [("y", 84.5), ("x", 10.0)]
    assert b.top_class is None and b.tonic_note == ""


def test_diagnostics_on_a_sample(spark, singers):
    rows = [(k, *r) for k, v in singers.items() for r in v]
    frames = tracked(spark, rows)
    rec = recordings(spark, [(k, 150.0, i, 150.0) for i, k in enumerate(singers)])
    d = diagnostics.tonic_diagnostic(frames, rec, groups=3)
    assert d.count() == 3 and {r.band for r in d.collect()} <= {"good", "ok", "broken", "error"}
    p = diagnostics.clip_preflight(frames, rec, hop=0.5, groups=2).collect()
    assert len(p) == 6 and all(r.passed and abs(r.tonic_diff) < 1e-6 for r in p)
    silent = tracked(spark, [("q", float(t), 100.0, False, 0.0) for t in range(60)])
    lone = recordings(spark, [("q", 60.0, 0, 100.0)])
    assert diagnostics.tonic_diagnostic(silent, lone, None).first().band == "error"
    assert not diagnostics.clip_preflight(silent, lone, hop=1.0, groups=None).first().passed


@pytest.mark.parametrize("block_rows", [7, 64, 100_000])
def test_long_features_do_not_depend_on_blocks(spark, singers, block_rows):
    """Excerpts in blocks of a few frames equal those that one task holds."""
    from pitchloom.plans import long_excerpts

    rows = [(k, *r) for k, v in singers.items() for r in v]
    rows += [("thin", float(t), 100.0 + t, t < 5, 0.9) for t in range(60)]
    rows += [("given", *r) for r in singer(61, 150, 0.5)]
    f = tracked(spark, rows).withColumn("wanted", F.when(F.col("recording_id") == "given", 75.0))
    got = long_excerpts.long_features(f, ["recording_id"], 0.5, "wanted", 20, block_rows=block_rows)
    base = f.filter("recording_id <> 'given'")
    plain = features.detected_features(base, ["recording_id"], 0.5, min_voiced=20)
    given = features.detected_features(f.filter("recording_id = 'given'"), ["recording_id"], 0.5, given="wanted", min_voiced=20)
    want = {r.recording_id: r for r in plain.unionByName(given).collect()}
    found = {r.recording_id: r for r in got.collect()}
    assert set(found) == set(want) and "thin" not in found and found["given"].given_hz == 75.0
    for k, r in want.items():
        assert found[k].tonic_hz == pytest.approx(r.tonic_hz, rel=1e-12), k
        assert np.allclose(found[k].features, r.features, atol=1e-12), k


def test_no_task_holds_a_long_recording_of_unknown_length(spark):
    """60,000 frames in blocks of 4,096: windows and joins are keyed by block throughout."""
    from pitchloom.operators.depth import equi_depth
    from pitchloom.plans import long_excerpts

    n, hop = 60_000, 0.1
    hz = 110 * F.pow(F.lit(2.0), F.floor(F.col("id") / 40) % 7 / 12.0)
    f = spark.range(n).select(
        F.lit("r").alias("recording_id"), (F.col("id") * hop).alias("ts"), hz.alias("f0_hz"), F.lit(True).alias("voiced"), F.lit(0.9).alias("voiced_prob")
    )
    sizes = equi_depth(f, ["recording_id"], [F.col("ts")], 4096).groupBy("block").count()
    assert sizes.agg(F.max("count")).first()[0] <= 4096
    out = long_excerpts.long_features(f, ["recording_id"], hop, block_rows=4096)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and ("lag(" in line or "row_number" in line or "windowspecdefinition" in line)]
    whole = [w for w in windows if "block" not in w.split("windowspecdefinition")[1].split("specifiedwindowframe")[0] and "f0_hz" in w]
    assert windows and not whole
    rec = spark.createDataFrame([("r", None, None)], "recording_id string, duration_s double, override_hz double")
    got = scoring.score_recordings(f, rec, as_probability, hop=hop, block_rows=4096).first()
    assert got.status == "ok" and got.n_segments == 1
    plain = features.detected_features(f, ["recording_id"], hop).first()
    assert out.first().tonic_hz == pytest.approx(plain.tonic_hz) and np.allclose(out.first().features, plain.features)


def test_octave_steps_lie_on_the_slope_limit(spark):
    """A step of one octave over two seconds is 600 cents a second for any tonic, so not below 600."""
    tonics = [60.15 + 0.3 * i for i in range(200)]
    rows = [(i, t, j, 95.81 * (1, 1.5, 2)[j]) for i, t in enumerate(tonics) for j in range(3)]
    frames = spark.createDataFrame(rows, "k int, tonic_hz double, ts int, f0_hz double")
    out = features.mark_excerpt(frames, ["k"], hop=1.0, tslope=600.0, ttime=0.0, loose_tslope=600.5)
    middle = out.filter("ts = 1").agg(F.count_if("stable"), F.count_if("loose")).first()
    assert tuple(middle) == (0, len(tonics))


def test_partitions_of_clips_are_not_merged(spark, singers):
    """Frames multiply after their shuffle, so its partitions stay as many as the session asks for."""
    df = tracked(spark, [(k, *r) for k, v in singers.items() for r in v])
    recs = df.groupBy("recording_id").agg(F.max("ts").alias("duration_s"))
    want = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert seg.clip_frames(df, recs).rdd.getNumPartitions() == want > 1


def executed(df):
    plan = df._jdf.queryExecution()
    df.collect()
    return plan.executedPlan().toString().split("Initial Plan")[0]


def test_excerpts_are_sorted_once_and_bins_are_no_rows(spark, singers):
    df = tracked(spark, [(k, *r) for k, v in singers.items() for r in v]).withColumn("given", F.lit(131.0))
    plan = executed(features.detected_features(df, KEY, 0.5, given="given", ttime=1.0))
    assert plan.count(" Sort [") == 1 and "Generate" not in plan


def test_candidates_do_not_multiply_frames(spark, singers):
    df = tracked(spark, [(k, *r) for k, v in singers.items() for r in v if r[2]])
    plan = executed(tonic.detect_tonic(df, KEY))
    # One row per candidate is all that is made; no bins are, nor a row per frame and candidate.
    assert plan.count("Generate") == 1 and "inline" not in plan


@pytest.mark.parametrize("least", [0, 1, 2, 3, 5, 50])
def test_runs_of_stable_frames(spark, least):
    flags = {"a": "1101110010111110", "b": "0000", "c": "111", "d": "1", "e": "0110"}
    rows = [(k, float(i), c == "1") for k, v in flags.items() for i, c in enumerate(v)]
    got = contour.excerpt_runs(spark.createDataFrame(rows, "recording_id string, ts double, stable boolean"), KEY, least)
    found = {k: "".join("1" if r.held else "0" for r in sorted(v, key=lambda r: r.ts)) for k in flags for v in [[r for r in got.collect() if r.recording_id == k]]}
    for k, v in flags.items():
        assert found[k] == "".join(("1" if len(run) >= least else "0") * len(run) if run[0] == "1" else run for run in brute_runs(v)), k


def brute_runs(flags):
    return ["".join(g) for _, g in itertools.groupby(flags)]
