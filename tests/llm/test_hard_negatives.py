"""Scores against plain products, and mining against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchloom.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, anchor_id string"


def brute(rows, anchors, positives=5, negatives=3, low=50, high=95):
    good = []
    for at, (i, v, label, *_) in enumerate(rows):
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) or abs(x) >= 65_536 for x in v):
            continue
        good.append((i, at, [math.floor(256 * x) for x in v], label))
    good.sort(key=lambda r: r[:2])
    out = []
    for a in (r for r in good if anchors(r[0])):
        scored = sorted((-sum(x * y for x, y in zip(a[2], r[2])), k, r) for k, r in enumerate(good) if r is not a)
        for p, _, r in [x for x in scored if x[2][3] == a[3]][:positives]:
            bounds = [x for x in scored if x[2][3] != a[3] and low * -p <= 100 * -x[0] <= high * -p][:negatives]
            out += [(a[0], r[0], k + 1, x[2][0], -p, -x[0]) for k, x in enumerate(bounds)]
    return sorted(out)


def mined(spark, rows, anchors, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in hard_negatives.mine(df, anchors, **options).collect())


@pytest.mark.parametrize("largest", [1, 200, 1 << 23])
def test_scores_are_inner_products(largest):
    rng = np.random.default_rng(largest)
    a, c = (rng.integers(-largest, largest + 1, (n, 13)) for n in (70, 1500))
    got = np.concatenate([s for _, s in hard_negatives.scores(a, hard_negatives.bit_planes(c))])
    assert (got == a @ c.T).all()


def test_components_that_a_shorter_vector_lacks_are_zero():
    a, c = np.array([[3, -4]]), np.arange(-20, 20).reshape(2, 20)
    ((_, s),) = hard_negatives.scores(a, hard_negatives.bit_planes(c))
    assert s.tolist() == [[16, -4]]
    ((_, s),) = hard_negatives.scores(c, hard_negatives.bit_planes(a))
    assert s.T.tolist() == [[16, -4]]


@pytest.mark.parametrize("options", [{}, {"block_rows": 7, "anchor_rows": 3}, {"positives": 2, "negatives": 50, "low": 0, "high": 100}])
def test_mining_against_brute_force(spark, options):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 16))
    x = centres[rng.integers(0, 6, 160)] + 0.4 * rng.normal(size=(160, 16))
    # A third holds one label; some rows are copies, some ids repeat.
    rows = [(int(k) if k != 77 else 76, v.tolist(), int(rng.integers(0, 4)) if k % 3 else 9) for k, v in enumerate(x)]
    rows += [(200 + k, rows[0][1], rows[0][2]) for k in range(9)]
    limits = {k: v for k, v in options.items() if "rows" not in k}
    want = brute(rows, lambda i: i % 10 == 0, **limits)
    assert want and mined(spark, rows, F.col("vec_id") % 10 == 0, **options) == want


def test_rows_that_take_no_part(spark):
    good = [(k, [1.0 - k / 20, k / 30], k % 2) for k in range(8)]
    odd = [(None, [1.0, 1.0], 0), (20, None, 0), (21, [1.0, None], 0), (22, [1.0, float("nan")], 1), (23, [float("inf"), 0.0], 1)]
    odd += [(24, [1.0, 1.0], None), (25, [70_000.0, 0.0], 1)]
    empty = [(26, [], 0), (27, [], 1), (28, [0.5], 1)]
    rows = good + odd + empty
    got = mined(spark, rows, F.col("vec_id") < 30)
    assert got == brute(rows, lambda i: i < 30)
    assert not {20, 21, 22, 23, 24, 25, None} & {i for r in got for i in (r[0], r[1], r[3])}
    # A score of 0 bounds scores of 0: empty vectors have positives and negatives like others.
    assert [r for r in got if r[0] == 26]


def test_empty_table_and_no_anchor(spark):
    assert mined(spark, [], F.col("vec_id") >= 0) == []
    assert mined(spark, [(1, [1.0], 0), (2, [1.0], 1)], F.col("vec_id") > 5) == []
    assert mined(spark, [(1, [1.0], 0), (2, [1.0], 1)], F.lit(True)) == []
    assert mined(spark, [(1, [1.0], 0), (2, [1.0], 1)], F.lit(None).cast("boolean")) == []
