"""Blocks of bounded size against plain sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchloom.operators import depth


def blocks_of(df, limit, order=("p", "i")):
    out = depth.equi_depth(df, ["k"], [F.col(c) for c in order], limit, rank="before")
    return depth.position(out, ["k"], "block", "before", list(order), "at")


def check(got, limit):
    """No block above the limit, blocks and positions in the order of the rows."""
    for _, rows in got.groupby("k"):
        assert rows.groupby("block").size().max() <= limit
        rows = rows.sort_values(["p", "i"], na_position="first")
        assert (np.diff(rows.block) >= 0).all()
        assert rows["at"].tolist() == list(range(len(rows)))


SPREADS = {
    "even": lambda r, n: np.arange(n),
    "one_instant": lambda r, n: np.full(n, 7),
    "burst": lambda r, n: np.where(np.arange(n) < n // 2, 10**12 + np.arange(n) // 50, r.integers(0, 10**15, n)),
    "doubling": lambda r, n: (2.0 ** r.uniform(0, 60, n)).astype(np.int64),
    "far_ends": lambda r, n: np.where(np.arange(n) % 2, -(2**62), 2**62) + np.arange(n),
}


@pytest.mark.parametrize("spread, limit", [*((s, 50) for s in SPREADS), ("even", 10_000), ("one_instant", 2)])
def test_no_block_above_the_limit(spark, spread, limit):
    rng = np.random.default_rng(4)
    n = 200 if limit == 2 else 3000
    p = SPREADS[spread](rng, n)
    rows = [("a", int(x), int(i)) for i, x in enumerate(rng.permutation(p))] + [("b", 5, 1)]
    got = blocks_of(spark.createDataFrame(rows, "k string, p long, i long").repartition(4), limit).toPandas()
    assert len(got) == n + 1
    check(got, limit)
    assert (got[got.k == "a"].block.nunique() == 1) == (n <= limit // 2) or limit >= n


def test_two_hundred_thousand_rows_in_one_burst(spark):
    """A recording of 200,000 frames within a second, beside one of a day."""
    burst = spark.range(200_000).select(F.lit("a").alias("k"), (1e6 + F.col("id") % 1000 * 1e-3).alias("p"), F.col("id").alias("i"))
    day = spark.range(20_000).select(F.lit("b").alias("k"), (F.col("id") * 4.32).alias("p"), F.col("id").alias("i"))
    got = blocks_of(burst.union(day), 4096).toPandas()
    check(got, 4096)
    assert got[got.k == "a"].block.nunique() <= 2 * -(-200_000 // 2048)


def test_odd_values(spark):
    values = [None, float("nan"), float("inf"), float("-inf"), -0.0, 0.0, 1e308, -1e308, 5e-324] * 12
    rows = [("a", v, i) for i, v in enumerate(values)] + [(None, 1.0, 1)]
    df = spark.createDataFrame(rows, "k string, p double, i int")
    got = depth.equi_depth(df, ["k"], [F.col("p"), F.col("i")], 10)
    assert got.count() == len(values)
    # Null, then from the least to NaN, as Spark sorts.
    at = got.orderBy("p", "i").select("block").toPandas().block
    assert (np.diff(at) >= 0).all()


def test_equal_rows_stay_together_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1, 1)] * 30 + [("a", 2, 1)], "k string, p long, i long")
    got = depth.equi_depth(df, ["k"], [F.col("p"), F.col("i")], 4).groupBy("p").agg(F.countDistinct("block").alias("n")).collect()
    assert {r.p: r.n for r in got} == {1: 1, 2: 1}
    assert depth.equi_depth(df.limit(0), ["k"], [F.col("p")], 4).count() == 0


def test_passes_read_what_the_last_one_left(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(depth, "scratch_folder", lambda spark, name: str(tmp_path / name))
    rows = [("a", 2**20 * (i // 1000) + i % 1000, i) for i in range(3000)] + [("b", 5, 1)]
    blocks_of(spark.createDataFrame(rows, "k string, p long, i long"), 50).count()
    first, second = [spark.read.parquet(str(tmp_path / "depth" / name)) for name in ("rows", "rows-0")]
    # The row of b lies in no over-full cell.
    assert (first.count(), second.count()) == (3001, 3000)
    assert first.select("_at").distinct().count() == 1 < second.select("_at").distinct().count()
