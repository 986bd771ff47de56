import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchloom.functions import pitch, text, vectors

from . import brute


def column(spark, values, kind, expr):
    rows = [(i, float(v) if isinstance(v, np.floating) else v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def random_hz(n=4000):
    rng = np.random.default_rng(7)
    edges = [60.0 * 2**k for k in range(-3, 7)]
    near = [np.nextafter(e, d) for e in edges for d in (0, 1e9)]
    return [float(x) for x in np.concatenate([rng.uniform(20, 3000, n), edges, near])]


def test_octave_reduction_follows_numpy(spark):
    rng = np.random.default_rng(1)
    xs = [float(x) for x in rng.uniform(-9000, 9000, 3000)]
    xs += [0.0, -1e-14, 1200.0, -1200.0, 2400.0, 1199.9999999999998, np.nextafter(2400.0, 0), -5.0, 1195.0]
    got = column(spark, xs, "double", pitch.octave_reduce(F.col("x")))
    assert got == [float(v) for v in np.mod(xs, 1200.0)]


def test_pitch_class_bins_follow_numpy_histogram(spark):
    rng = np.random.default_rng(2)
    xs = [float(x) for x in rng.uniform(-4000, 4000, 3000)]
    xs += [10.0 * k for k in range(-130, 130)] + [-1e-14]
    xs += [float(np.nextafter(10.0 * k, 0)) for k in range(1, 121)]
    got = column(spark, xs, "double", pitch.pitch_class_bin(F.col("x")))
    assert np.array_equal(np.bincount(got, minlength=120), brute.profile_counts(np.array(xs)))


def test_fixed_range_bins_follow_numpy_edges(spark):
    edges = np.linspace(60, 120, 201)
    xs = [float(v) for e in edges for v in (np.nextafter(e, 0), e, np.nextafter(e, 1e9))]
    got = column(spark, xs, "double", pitch.edge_bin(F.col("x"), 60.0, 120.0, 200))
    inside = [g for g in got if g is not None]
    assert np.array_equal(
        np.bincount(inside, minlength=200), np.histogram(xs, bins=200, range=(60, 120))[0]
    )
    assert got[0] is None and got[-1] is None


def test_folding_follows_halving_and_doubling(spark):
    xs = random_hz()
    once = column(spark, xs, "double", pitch.fold_into(F.col("x")))
    assert once == [brute.fold(x) for x in xs]
    assert column(spark, once, "double", pitch.fold_into(F.col("x"))) == once


@pytest.mark.parametrize("target", [61.0, 120.0, 240.0, 333.3, 60.0 * 2**5])
def test_lifting_doubles_while_twice_is_below(spark, target):
    def loop(c):
        while 2 * c < target:
            c *= 2
        return c

    xs = [float(x) for x in np.random.default_rng(3).uniform(60, 120, 500)] + [60.0, 120.0, target / 4, target / 2]
    assert column(spark, xs, "double", pitch.lift_towards(F.col("x"), F.lit(target))) == [loop(x) for x in xs]


@pytest.mark.parametrize("median", [100.0, 128.0, 211.7])
def test_override_moves_next_to_the_median(spark, median):
    xs = random_hz(1000) + [median * 1.5 * 2**k for k in range(-4, 5)] + [median * 0.75]
    got = column(spark, xs, "double", pitch.fold_override(F.col("x"), F.lit(median)))
    assert got == [brute.fold_override(x, median) for x in xs]
    assert all(0.75 * median <= g < 1.5 * median for g in got)


def test_note_names(spark):
    xs = [440.0, 441.0, 261.6255653, 277.2, 0.0, -3.0, None, 16.3515978]
    got = column(spark, xs, "double", pitch.note_name(F.col("x")))
    assert got == ["A4", "A4 (+4¢)", "C4", "C#4", "", "", "", "C0"]


def test_chromatic_table(spark):
    got = column(spark, [36, 69, 71], "int", pitch.chromatic_label(F.col("x")))
    assert got == ["C2  ·  65.4 Hz", "A4  ·  440.0 Hz", "B4  ·  493.9 Hz"]


def test_differences_and_bands(spark):
    got = column(spark, [590.0, 610.0, -610.0, 1200.0], "double", pitch.nearest_pitch_class_diff(F.col("x")))
    assert got == [590.0, -590.0, 590.0, 0.0]
    bands = column(spark, [25.0, -25.1, 50.0, -50.1, None], "double", pitch.error_band(F.col("x")))
    assert bands == ["good", "ok", "ok", "broken", None]
    sharp = column(spark, [880.0], "double", pitch.cents_between(F.col("x"), F.lit(440.0)))
    assert sharp == [1200.0]
    assert column(spark, [0.0, -1.0, 2.0, None], "double", pitch.positive_or_null(F.col("x"))) == [None, None, 2.0, None]


def test_paths(spark):
    paths = ["file:/data/audio/r1/x/a.b.mp3", "/data/audio/r1/.hidden", "/data/audio/r.2/song"]
    keys = column(spark, paths, "string", text.recording_key(F.col("x"), "/data/audio"))
    assert keys == ["r1/x/a.b", "r1/.hidden", "r.2/song"]
    sib = column(spark, paths[:1], "string", text.sibling_path(F.col("x"), "/data/audio/", "/data/feat", ".t"))
    assert sib == ["/data/feat/r1/x/a.b.t"]
    exts = column(spark, ["A.MP3", "b.wav", "c", ".mp3", "d.txt"], "string", text.has_extension(F.col("x")))
    assert exts == [True, True, False, False, False]
    hosts = column(spark, ["https://youtu.be/x", "https://a.org"], "string", text.mentions_host(F.col("x")))
    assert hosts == [True, False]


def test_excerpt_rule(spark):
    d = F.col("x")
    pair = F.concat_ws("/", text.excerpt_start(d), text.excerpt_length(d))
    assert column(spark, [180, 181, 200, 1498], "bigint", pair) == ["0/180", "60/90", "66/90", "499/90"]


def test_report_text(spark):
    assert column(spark, [0.845, 0.12345, 0.0005], "double", text.percent(F.col("x"))) == [84.5, 12.3, 0.0]
    assert column(spark, [0.1], "double", text.bar_text(F.col("x"))) == ["█████"]
    assert column(spark, ["S R G"], "string", text.token_count(F.col("x"))) == [3]
    assert column(spark, ["Kalyāṇi", "Tōḍi"], "string", text.name_matches(F.col("x"), "YĀṆ")) == [True, False]


def test_vector_functions(spark):
    nan, inf = float("nan"), float("inf")
    rows = [[1.0, 3.0, 3.0, 2.0], [0.0, 0.0, 0.0, 0.0], [1.0, -1.0, 0.0, 0.0], [nan, 1.0, inf, 0.0]]
    c = F.col("x")
    kind = "array<double>"
    assert column(spark, rows[:3], kind, vectors.argmax(c)) == [1, 0, 0]
    top = column(spark, rows[:1], kind, vectors.top_k(c, 3))[0]
    assert [(t["value"], t["bin"]) for t in top] == [(3.0, 2), (3.0, 1), (2.0, 3)]
    assert column(spark, rows, kind, vectors.sums_to_zero(c)) == [False, True, True, False]
    assert column(spark, rows, kind, vectors.all_zero(c)) == [False, True, False, False]
    assert column(spark, rows, kind, vectors.has_nan(c)) == [False, False, False, True]
    assert column(spark, rows, kind, vectors.has_inf(c)) == [False, False, False, True]
    assert column(spark, rows[:3], kind, vectors.nonzero_count(c)) == [4, 0, 1]
    cos = column(spark, rows[:3], kind, vectors.cosine(c, F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0)])))
    assert cos[0] == pytest.approx(1 / math.sqrt(23)) and math.isnan(cos[1]) and cos[2] == pytest.approx(math.sqrt(0.5))
