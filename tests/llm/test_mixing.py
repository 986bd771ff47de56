"""Targets, limits and the schedule against plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pitchloom.llm import mixing


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Source sizes to targets, sharing what is over again until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(full.values())
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] >= most * sizes[s]]
        if not over:
            return {**full, **share}
        full |= {s: most * sizes[s] for s in over}


def check(rows, got):
    sizes, taken = defaultdict(int), defaultdict(int)
    for source, text in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = plain_targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert t - 1 - 1e-6 <= taken[s] <= t + 1e-6


def rows_of(seed, n=300):
    rng = random.Random(seed)
    sources = ["hot"] * 12 + ["a", "b", "é", "Z", "zz", None, "tiny"]
    return [(rng.choice(sources), rng.choice([None, "", "w"]) if rng.random() < 0.1 else " w\n" * rng.randint(0, 60)) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_limits(spark, seed, monkeypatch):
    monkeypatch.setattr(mixing, "STRETCH_ROWS", 40)
    monkeypatch.setattr(mixing, "CHUNK_SLOTS", 64)
    monkeypatch.setattr(mixing, "SLOTS", 900)
    rows = rows_of(seed)
    df = spark.createDataFrame([(k, *r, "x") for k, r in enumerate(rows)], "doc_id long, source string, text string, target string")
    mix = mixing.mix(df)
    got = mix.rows.collect()
    check(rows, got)
    again = mixing.mix(df.repartition(5)).rows
    assert Counter(again.select("doc_id", "taken").collect()) == Counter((r.doc_id, r.taken) for r in got)
    slots = mix.schedule.collect()
    assert len({(s["rank"], s["block"]) for s in slots}) == len(slots)
    pieces = mix.pieces.groupBy("rank", "block").agg(F.sum("piece").alias("n")).join(mix.schedule, ["rank", "block"])
    assert pieces.filter("n != words").count() == 0


def test_points_are_spread(spark):
    points = sorted(r.point for r in mixing._points(spark, 1000).collect())
    assert points == sorted(j * mixing.GOLDEN % 2**32 for j in range(1000))
    high = mixing._points(spark, 5).withColumn("slot", F.col("slot") + 123_456_789_012)
    assert high.count() == 5
    gaps = [b - a for a, b in zip(points, points[1:])]
    assert max(gaps) < 2.7 * 2**32 / 1000


def test_odd_tables(spark):
    kind = "doc_id long, source string, text string"
    assert mixing.mix(spark.createDataFrame([], kind)).rows.count() == 0
    rows = [(None, None, None), (1, "a", ""), (1, "a", "")]
    assert [r.taken for r in mixing.mix(spark.createDataFrame(rows, kind)).rows.collect()] == [0, 0, 0]
    rows = [(1, "a", "x y z"), (1, "a", "x y z"), (None, "b", "one"), (2, None, "w " * 50)]
    check([r[1:] for r in rows], mixing.mix(spark.createDataFrame(rows, kind)).rows.collect())


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = entry.queries()["op4_source_mixing"](spark, sf).join(docs.select("doc_id", "source"), "doc_id").collect()
    check([(r.source, r.text) for r in docs.select("source", "text").collect()], got)
