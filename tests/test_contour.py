import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchloom.operators import contour, histograms, order_stats
from pitchloom.operators.blocks import dense_index, running_max, spread_blocks, time_block
from pitchloom.plans import features

from . import brute

STEP = 0.0625


def random_contour(seed, n, silent=0.15, jump=0.1):
    """Steps and holds with silent frames: runs of all lengths."""
    rng = np.random.default_rng(seed)
    walk = np.where(rng.random(n) < jump, rng.uniform(-300, 300, n), rng.normal(0, 15, n))
    hz = 150 * 2 ** (np.clip(np.cumsum(walk), -900, 900) / 1200)
    hz[rng.random(n) < silent] = 0.0
    return np.arange(n) * STEP, hz


CONTOURS = {
    "long": random_contour(1, 700),
    "short": random_contour(2, 40),
    "one": random_contour(3, 1, silent=0),
    "two": random_contour(4, 2, silent=0),
    "silent": (np.arange(30) * STEP, np.zeros(30)),
    "nan": (np.arange(90) * STEP, np.where(np.arange(90) % 9 == 4, np.nan, random_contour(5, 90)[1])),
}
TONICS = {"long": 140.0, "short": 151.0, "one": 150.0, "two": 150.0, "silent": 150.0, "nan": 147.0}


def frames(spark, contours=CONTOURS):
    rows = [(k, float(t), float(f)) for k, (ts, fs) in contours.items() for t, f in zip(ts, fs)]
    return spark.createDataFrame(rows, "recording_id string, ts double, f0_hz double")


def tonics(spark, values=TONICS):
    return spark.createDataFrame(list(values.items()), "recording_id string, tonic_hz double")


def segments(spark, rows):
    return spark.createDataFrame(rows, "recording_id string, kind string, start_s double, end_s double")


@pytest.mark.parametrize("block_s", [STEP, 0.5, 3.0, 600.0])
def test_held_frames_do_not_depend_on_blocks(spark, block_s):
    f = frames(spark).withColumn("block", time_block(F.col("ts"), block_s))
    got = contour.annotate_stable(f, tonics(spark), ttime=0.4).toPandas()
    assert len(got) == sum(len(ts) for ts, _ in CONTOURS.values())
    for rec, (ts, hz) in CONTOURS.items():
        mine = got[got.recording_id == rec].sort_values("ts")
        assert list(mine.frame_idx) == list(range(len(ts)))
        assert np.array_equal(mine.held.to_numpy(), brute.held(ts, hz, TONICS[rec], ttime=0.4)), rec


def test_run_of_exactly_the_minimum_length(spark):
    # 20 frames on one pitch, then a leap; int(0.5 / dt) = 8 at this step.
    def runs(n):
        hz = np.concatenate([np.full(n, 200.0), [900.0, 100.0, 900.0, 100.0]])
        return {"r": (np.arange(len(hz)) * STEP, hz)}

    for n, least in [(9, 8), (8, 8)]:
        c = runs(n)
        f = frames(spark, c).withColumn("block", time_block(F.col("ts"), 0.2))
        out = contour.annotate_stable(f, tonics(spark, {"r": 150.0}), ttime=0.5)
        kept = out.filter("held").count()
        # The last frame of the plateau sees the leap, so n - 1 are stable.
        assert kept == (n - 1 if n - 1 >= least else 0) == int(brute.held(*c["r"], 150.0, ttime=0.5).sum())


def test_zero_minimum_keeps_every_stable_frame(spark):
    f = frames(spark).withColumn("block", time_block(F.col("ts"), 1.0))
    out = contour.annotate_stable(f, tonics(spark), ttime=STEP / 2)
    assert out.filter("stable <> held").count() == 0


SEGMENTS = [
    ("long", "nyas", 2.0, 4.0),
    ("long", "nyas", 3.0, 5.0),
    ("long", "nyas", 3.0, 3.0),
    ("long", "tani", 10.0, 20.0),
    ("long", "tani", 19.0, 19.5),
    ("long", "nyas", 18.0, 22.0),
    ("long", "tani", 30.0, 29.0),
    ("short", "tani", 0.5, 1.0),
    ("elsewhere", "nyas", 0.0, 9.0),
]


@pytest.mark.parametrize("block_s", [0.1, 1.0, 7.0, 600.0])
def test_sweep_counts_closed_segments(spark, block_s):
    got = contour.sweep_segments(frames(spark), segments(spark, SEGMENTS), ["nyas", "tani"], block_s).toPandas()
    assert len(got) == sum(len(ts) for ts, _ in CONTOURS.values())
    for r in got.itertuples():
        for kind, n in (("nyas", r.n_nyas), ("tani", r.n_tani)):
            want = sum(s[0] == r.recording_id and s[1] == kind and s[2] <= r.ts <= s[3] for s in SEGMENTS)
            assert n == want, r


@pytest.mark.parametrize("block_s", [0.5, 600.0])
def test_annotated_features_against_numpy(spark, block_s):
    segs = segments(spark, SEGMENTS)
    got = features.annotated_features(frames(spark), tonics(spark), segs, ttime=0.4, block_s=block_s)
    got = {r.recording_id: r for r in got.collect()}
    for rec, (ts, hz) in CONTOURS.items():
        pick = lambda kind: [s[2:] for s in SEGMENTS if s[0] == rec and s[1] == kind]  # noqa: E731, B023
        want = brute.annotated(ts, hz, TONICS[rec], pick("nyas"), pick("tani"), ttime=0.4)
        assert (want is None) == (rec not in got), rec
        if want is not None:
            dens = np.concatenate([w / 10 / w.sum() for w in want])
            assert np.allclose(got[rec].features, dens, atol=1e-12)
    assert got["long"].nyas_source == "segments" and got["short"].nyas_source == "stable"


def test_recording_without_tonic_drops_out(spark):
    only = {k: v for k, v in TONICS.items() if k != "long"}
    got = features.annotated_features(frames(spark), tonics(spark, only), segments(spark, SEGMENTS), ttime=0.4)
    assert "long" not in {r.recording_id for r in got.collect()}


def test_profile_support_and_properties(spark):
    def profile(shift=0.0, tonic=150.0, n=10):
        hz = 160 * 2 ** (np.arange(n) * 37.0 / 1200 + shift / 1200)
        f = frames(spark, {"r": (np.arange(n) * STEP, hz)})
        f = f.withColumn("cents", F.lit(1200.0) * F.log2(F.col("f0_hz") / tonic))
        rows = histograms.pitch_class_profile(f, ["recording_id"]).collect()
        return np.array(rows[0].density) if rows else None

    assert profile(n=9) is None
    base = profile()
    assert base.sum() * 10 == pytest.approx(1.0)
    assert np.allclose(profile(tonic=300.0), base)
    assert np.allclose(profile(shift=50.0), np.roll(base, 5))


def test_dense_index_and_running_max_over_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [("a", int(p), float(v)) for p, v in zip(rng.permutation(500), rng.random(500))]
    rows += [("b", 3, 0.5)]
    df = spark.createDataFrame(rows, "k string, p int, v double")
    blocked = spread_blocks(df, ["k"], F.col("p"), 20)
    assert blocked.select("block").distinct().count() >= 20
    got = dense_index(blocked, ["k"], "block", ["p"], "i", total="n").toPandas()
    assert (got[got.k == "a"].p == got[got.k == "a"].i).all()
    assert dict(got.groupby("k").n.max()) == {"a": 500, "b": 1}
    best = running_max(blocked, ["k"], "block", ["p"], "v", "m").toPandas().sort_values("p")
    a = best[best.k == "a"]
    want = np.concatenate([[np.nan], np.maximum.accumulate(a.v.to_numpy())[:-1]])
    assert np.allclose(a.m.astype(float).to_numpy(), want, equal_nan=True)


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 1001])
def test_exact_median(spark, n):
    rng = np.random.default_rng(n)
    v = np.round(rng.normal(200, 40, n), 1)
    df = spark.createDataFrame([("k", float(x)) for x in v] + [("x", 1.0)], "k string, v double")
    got = {r.k: r["median"] for r in order_stats.exact_median(df, ["k"], "v").collect()}
    assert got == {"k": pytest.approx(np.median(v)), "x": 1.0}


def test_error_summary_takes_the_upper_median(spark):
    df = spark.createDataFrame([(float(x),) for x in (10, 25, 30, 60)], "e double")
    r = order_stats.error_summary(df, "e").first()
    assert (r.n, r.mean_abs, r.median_abs, r.max_abs) == (4, 31.25, 30.0, 60.0)
    assert (r.n_good, r.n_ok, r.n_broken) == (2, 3, 1)


@pytest.mark.parametrize("block_s", [0.3, 600.0])
def test_hold_times(spark, block_s):
    f = frames(spark).withColumn("block", time_block(F.col("ts"), block_s))
    got = contour.hold_times(f, last=9.0).toPandas()
    assert set(got.hold_s) == {STEP, 9.0} and (got.hold_s == 9.0).sum() == len(CONTOURS)


def test_frame_step_of_a_single_frame(spark):
    got = {r.recording_id: r["dt"] for r in contour.frame_step(frames(spark)).collect()}
    assert got["one"] == 0.0044 and got["long"] == STEP


def test_median_of_values_within_one_cell(spark):
    """Three thousand distinct values in one cell, beside equal ones and a null."""
    rng = np.random.default_rng(12)
    values = {"dense": 100 + rng.random(3001) * 1e-3, "even": 100 + rng.random(500) * 1e-6, "same": np.full(40, -3.25), "one": np.array([7.0])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("dense", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.n, r.lower, r.upper) for r in order_stats.middle_values(df, ["k"], "v").collect()}
    assert got == {k: (len(v), np.sort(v)[(len(v) - 1) // 2], np.sort(v)[len(v) // 2]) for k, v in values.items()}


@pytest.mark.parametrize("block_rows", [2, 33, 100_000])
def test_annotated_counts_do_not_depend_on_blocks_by_rank(spark, block_rows):
    """Frames in bursts: a steady step within, hours between."""
    uneven = {k: (ts + 5000.0 * (np.arange(len(ts)) // 60), hz) for k, (ts, hz) in CONTOURS.items()}
    segs = [("long", "nyas", 1.0, 5_010.0), ("long", "nyas", 3.0, 2.0), ("long", "nyas", 4.0, 25_003.0), ("long", "tani", 0.0, 0.5)]
    segs += [("short", "tani", 1.0, 1.1), ("short", "nyas", -5.0, 1e9), ("other", "nyas", 0.0, 1.0), ("long", None, 0.0, 9.0)]
    got = {}
    for name, options in {"time": {"block_s": 600.0}, "rank": {"block_rows": block_rows}}.items():
        out = features.annotated_counts(frames(spark, uneven), tonics(spark), segments(spark, segs), **options).collect()
        got[name] = {r.recording_id: (list(r.nyas), list(r.duration), list(r.stable)) for r in out}
    assert got["rank"] == got["time"] and sum(got["rank"]["long"][0]) > 0


def test_cover_of_a_burst_in_blocks(spark):
    """200,000 frames within a second and segments over parts of it."""
    f = spark.range(200_000).select(F.lit("a").alias("recording_id"), (100 + F.col("id") * 5e-6).alias("ts"), (100 + F.col("id") % 50.0).alias("f0_hz"))
    segs = [("a", "nyas", 100.0 + k * 0.1, 100.0 + k * 0.1 + 0.25) for k in range(8)]
    out = contour.sweep_segments(f, segments(spark, segs), ["nyas"], block_rows=10_000)
    assert out.groupBy("block").count().agg(F.max("count")).first()[0] <= 10_000
    got = out.select("ts", "n_nyas").toPandas()
    want = sum((got.ts >= s[2]) & (got.ts <= s[3]) for s in segs)
    assert len(got) == 200_000 and (got.n_nyas == want).all()
    held = contour.annotate_stable(out.select("recording_id", "block", "ts", "f0_hz"), spark.createDataFrame([("a", 100.0)], "recording_id string, tonic_hz double"))
    assert held.agg(F.max("frame_idx"), F.count("*")).first()[:2] == (199_999, 200_000)
