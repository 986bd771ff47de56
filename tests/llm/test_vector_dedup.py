"""Graphs and links against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pitchloom.llm import vector_dedup

SF = "/root/testdata/sf0.01"


def clustered(n, seed, dim=32):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for k in range(0, n, 5):
        x[k] = x[k // 2] + 0.2 * rng.normal(size=dim)
    x[: n // 10] = x[0] + 0.15 * rng.normal(size=(n // 10, dim))
    return x.astype(np.float32)


def brute(rows, least=0.95):
    """(id, links, component, kept) per row by all pairs in double precision."""
    good = []
    for _, v in rows:
        ok = v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v)
        good.append(np.array(v, np.float32).astype(float) if ok else None)
    n = len(rows)
    label, count = list(range(n)), [0] * n
    for a in range(n):
        for b in range(a):
            x, y = good[a], good[b]
            if x is None or y is None or len(x) != len(y):
                continue
            if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                count[a] += 1
                count[b] += 1
                old, new = label[a], label[b]
                label = [new if v == old else v for v in label]
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(n) if label[m] == label[k] and rows[m][0] is not None]
        c = min(ids) if ids else None
        out.append((i, count[k], c, c == i))
    return sorted(out, key=repr)


def test_search_recall_against_brute_force():
    x = vector_dedup._unit(clustered(3000, 1)).astype(np.float32)
    graph = vector_dedup.Graph(x)
    assert graph.audit(0.95) >= 0.98
    want = {(a, b) for a, b in zip(*np.nonzero(x @ x.T >= 0.95))}
    got = set(zip(*(c.tolist() for c in graph.within(x, 0.95))))
    assert len(got & want) >= 0.99 * len(want) and not {p for p in got if x[p[0]] @ x[p[1]] < 0.949}


def test_a_beam_as_wide_as_the_shard_is_exact():
    x = vector_dedup._unit(clustered(300, 2)).astype(np.float32)
    ids, sims = vector_dedup.Graph(x).search(x, 300)
    assert (np.sort(ids, axis=1)[:, -1] == 299).all() and np.isfinite(sims).mean() > 0.99


@pytest.mark.parametrize("n", [1, 2, 40, 70])
def test_small_graphs(n):
    x = vector_dedup._unit(clustered(80, 3)[:n]).astype(np.float32)
    got = set(zip(*(c.tolist() for c in vector_dedup.Graph(x).within(x, 0.9))))
    assert got == {(a, b) for a, b in zip(*np.nonzero(x @ x.T >= 0.9))}


def test_links_components_and_odd_rows(spark):
    x = clustered(250, 4, dim=16)
    rows = [(k + 10, [float(c) for c in v]) for k, v in enumerate(x)]
    rows += [(1000 + k, rows[5][1]) for k in range(30)] + [(12, rows[2][1]), (None, rows[7][1]), (None, [9.0] * 16)]
    rows += [(1, None), (2, []), (3, [0.0] * 16), (4, [float("nan")] * 16), (5, [None] * 16), (6, [float("inf")] + [1.0] * 15), (7, [1.0, 2.0]), (8, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("kept", F.lit("old"))
    got = vector_dedup.link_vectors(df, shard_rows=60).select("vec_id", "n_links", "component_id", "kept").collect()
    want = brute(rows)
    want = [(*r[:3], r[0] == r[2]) for r in want]
    assert sorted([tuple(r) for r in got], key=repr) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vector_dedup.link_vectors(df).count() == 0


def test_query(spark):
    got = entry.queries()["op5_vector_graph_dedup"](spark, SF)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute(rows)
