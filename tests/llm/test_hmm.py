"""Scores against sums over all state paths, counts against plain Python."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pitchloom.llm import hmm


def model(states=3, symbols=5, seed=2):
    rng = np.random.default_rng(seed)
    return hmm.Model(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(symbols), states).T)


def paths(m, text):
    """Probability of every path of states."""
    for path in itertools.product(range(len(m.start)), repeat=len(text)):
        p = m.start[path[0]] * m.emit[text[0], path[0]]
        for a, b, w in zip(path, path[1:], text[1:]):
            p *= m.move[a, b] * m.emit[w, b]
        yield path, p


TEXTS = [np.array(t, np.int32) for t in ([0, 1, 4, 4, 2], [3, 3, 1], [4, 0, 2], [2])]


def test_forward_is_the_sum_over_paths():
    m = model()
    want = [math.log10(sum(p for _, p in paths(m, t))) for t in TEXTS]
    assert hmm.Walk(TEXTS).log10(m) == pytest.approx(want)


def test_expected_counts():
    m = model()
    emitted, moved, started = np.zeros((5, 3)), np.zeros((3, 3)), np.zeros(3)
    want = [np.zeros_like(x) for x in (emitted, moved, started)]
    for t in TEXTS:
        total = sum(p for _, p in paths(m, t))
        for path, p in paths(m, t):
            want[2][path[0]] += p / total
            for w, s in zip(t, path):
                want[0][w, s] += p / total
            for a, b in zip(path, path[1:]):
                want[1][a, b] += p / total
    hmm.Walk(TEXTS).expect(m, emitted, moved, started)
    for got, w in zip((emitted, moved, started), want):
        assert np.allclose(got, w, atol=1e-5)


def test_base_and_counts_and_a_proper_model(spark):
    rows = [
        (1, "The cat  the\tDOG\x0b end"), (2, "the the cat"), (3, None), (4, ""), (5, "unseen words here the"),
        (6, "É\xa0b é\xa0B Σ"), (2, "the the cat"), (None, "the bird"), (7, "cat " * 3000),
    ]
    df = spark.createDataFrame([(*r, r[0] not in (5, 6), "x") for r in rows], "doc_id long, text string, learn boolean, score string")
    df = df.withColumns({c: F.lit("y") for c in ("symbols", "rare", "_row", "word", "_kept")})
    got = hmm.score(df, F.col("learn"), frequent=2, classes=3, states=2, rounds=2)
    tokens = {r: [*hmm.words((r[1] or "").encode()), hmm.END] for r in rows}
    assert tokens[rows[5]] == ["É\xa0b".encode(), "é\xa0b".encode(), "Σ".encode(), hmm.END]
    c = Counter(w for r in rows if r[0] not in (5, 6) for w in tokens[r])
    n, v = sum(c.values()), len(c)
    seen = Counter()
    for r in got.collect():
        (row,) = {x for x in rows if x[0] == r.doc_id}
        assert r.n_tokens == len(tokens[row]) and r.train_tokens == n
        assert r.n_known == sum(w in c for w in tokens[row])
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[row]))
        assert r.score < 0
        seen[r.doc_id] += 1
    assert seen == Counter(r[0] for r in rows)


def test_shares_of_a_class_add_up(spark):
    texts = ["aa bb cc dd ee", "aa bb", "aa"]
    df = spark.createDataFrame([(t.encode(),) for t in texts], "_text binary")
    vocab = hmm.vocabulary(hmm.word_counts(df), 1, 2)
    c = Counter(w for t in texts for w in t.encode().split())
    assert set(vocab.frequent) == {b"aa"} and vocab.tokens == 11 and vocab.size == 6
    for k in range(2):
        rare = [w for w in c if w != b"aa" and zlib.crc32(w[-3:]) % 2 == k]
        total = sum(c[w] + 0.1 for w in rare) + 0.1
        assert 10 ** vocab.class_logs()[vocab.end + 1 + k] == pytest.approx(total)


def test_no_training_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in hmm.score(df, F.lit(False), frequent=2, classes=3, rounds=1).collect()}
    assert got[1].n_known == 0 and got[1].train_tokens == 0 and got[1].base_score == pytest.approx(0.0)
    assert got[2].n_tokens == 1
    assert hmm.score(df.filter("doc_id > 9"), F.lit(True), rounds=1).count() == 0


def test_training_raises_held_out_probability(spark):
    got = entry.queries()["op2_hidden_markov_score"](spark, "/root/testdata/sf0.001")
    r = got.filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.count("*").alias("n")).first()
    assert r.n > 5 and r.s > r.b


def test_what_is_rare_does_not_depend_on_how_many_words_there_are(spark):
    few = [f"often often often w{k} w{k} w{k} once{k}" for k in range(20)]
    many = few + [f"x{k} x{k} x{k}" for k in range(101_000)]
    for texts in (few, many):
        df = spark.createDataFrame([(t.encode(),) for t in texts], "_text binary")
        vocab = hmm.vocabulary(hmm.word_counts(df), None, 64, hmm.OFTEN)
        assert vocab.cut == hmm.OFTEN and vocab.n_frequent == 21 + len(texts) - 20
        assert vocab.distinct.sum() == 20


def test_parts_do_not_change_scores(spark, monkeypatch):
    rows = [(k, " ".join(f"w{(k * j) % 17} v{k % 5}" for j in range(30)), k % 4 > 0) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean").coalesce(2)
    run = lambda: {r.doc_id: r.score for r in hmm.score(df, F.col("learn"), states=3, rounds=2, classes=8).collect()}
    whole = run()
    monkeypatch.setattr(hmm, "PART", 200)
    parts = run()
    assert len(whole) == 60 and all(parts[k] == pytest.approx(whole[k], rel=1e-3) for k in whole)
