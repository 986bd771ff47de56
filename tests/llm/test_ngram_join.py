"""The join and the components against brute force."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pitchloom.llm import ngram_join
from pitchloom.llm.components import connected
from pitchloom.llm.shingles import shingle_sets
from pitchloom.llm.staging import Stage

SF = "/root/testdata/sf0.001"


def grams(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, percent):
    """Component per row index; rows are (id, text)."""
    sets = [grams(t, n) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                old, new = label[a], label[b]
                label = [new if v == old else v for v in label]
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if label[m] == label[k] and rows[m][0] is not None]
        out.append((i, len(sets[k]), min(ids) if ids else None))
    return sorted(out, key=repr)


def made(seed, copies=40):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 12, 40, 90]))) for _ in range(12)]
    rows = []
    for k in range(copies):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((k, rng.choice([" ", "\n", "\t "]).join(w).title()))
    return rows + [(100, None), (101, ""), (102, "  \n"), (103, "one two"), (104, "ONE two"), (105, "one"), (7, rows[7][1]), (None, rows[3][1]), (None, "alone here by itself")]


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80), (2, 50)])
def test_against_brute_force(spark, n, percent):
    rows = made(n)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("x"))
    got = ngram_join.similar(df, n, percent).collect()
    assert sorted([(r._key, r.n_shingles, r.component_id) for r in got], key=repr) == brute(rows, n, percent)
    assert len({r._row for r in got}) == len(rows)


def test_large_clusters_are_joined_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TASK_GRAMS", 150)
    rows = made(9, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.similar(df, 3, 70).collect()
    assert sorted([(r._key, r.n_shingles, r.component_id) for r in got], key=repr) == brute(rows, 3, 70)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.similar(df).count() == 0
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [(r.n_shingles, r.component_id) for r in ngram_join.similar(df).collect()] == [(0, 1)]


def test_hashed_sets_have_the_right_size():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab cd efg É x\x0by".split()) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    assert [len(s) for s in shingle_sets([t.encode() for t in texts], 3)] == [len(grams(t, 3)) for t in texts]
    assert shingle_sets([], 3) == []


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(50)] + [(200, k) for k in range(100, 160)] + [(300, 300), (301, 302), (302, 301)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r.node: r.component for r in connected(df, Stage(spark, "test"), "c").collect()}
    assert all(got[k] == 0 for k in range(51)) and all(got[k] == 100 for k in range(100, 160)) and got[200] == 100
    assert got[302] == 301


def test_query(spark):
    got = entry.queries()["op7_ngram_jaccard_join"](spark, SF)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute(rows, 3, 90)
