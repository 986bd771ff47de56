"""Searches against brute force, the whole query against a plain version, and held-out accuracy."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pitchloom.llm import toxicity


def made_vectors(seed, n, terms, most=6):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        some = rng.choice(terms, rng.integers(0, most), replace=False)
        out.append(toxicity.unit({int(t): float(rng.integers(1, 4)) for t in some}))
    return out


@pytest.mark.parametrize("n", [0, 1, 63, 64, 700])
@pytest.mark.parametrize("k", [1, 15])
def test_nearest_are_exact(n, k):
    vectors = made_vectors(n, n, 12)
    index = toxicity.Index.build(vectors, 12)
    for query in made_vectors(99, 40, 12):
        if not query:
            continue
        every = [(-sum(w * v.get(t, 0) for t, w in query.items()), row) for row, v in enumerate(vectors)]
        want = sorted((round(c, 9), row) for c, row in every if c < 0)[:k]
        rows, cosines = index.nearest(query, k)
        assert [round(-c, 9) for c in cosines] == [c for c, _ in want]
        # Rows are told apart by their numbers unless cosines differ by rounding alone.
        assert all(abs(sum(w * vectors[r].get(t, 0) for t, w in query.items()) - c) < 1e-9 for r, c in zip(rows, cosines))
        assert rows.tolist() == sorted(rows.tolist(), key=lambda r: (-cosines[rows.tolist().index(r)], r))


def test_blocks_below_the_bound_are_left_out(monkeypatch):
    scored = []
    plain = toxicity.Index._scored
    monkeypatch.setattr(toxicity.Index, "_scored", lambda self, t, w, blocks, *a: scored.extend(blocks) or plain(self, t, w, blocks, *a))
    far = [toxicity.unit({0: 1.0, 1 + k % 3: 5.0}) for k in range(2000)]
    rows, _ = toxicity.Index.build(far + [{0: 1.0}] * 20, 4).nearest({0: 1.0}, 5)
    assert rows.tolist() == [2000, 2001, 2002, 2003, 2004] and len(scored) == toxicity.FIRST_BLOCKS


def test_levels_never_fall_and_have_a_share_without_neighbours():
    levels = toxicity.monotone([0, 5, 1, 0, 0, 0, 0, 0, 3, 40, 2], [100, 10, 9, 0, 0, 0, 0, 0, 6, 40, 200])
    assert levels[:10] == sorted(levels[:10]) and levels[9] > 0.9 and levels[10] < 0.05
    assert toxicity.monotone([0.0] * 11, [0.0] * 11) == [0.5] * 11


def test_least_ratio_is_the_quantile():
    assert toxicity.least_ratio(1, 0.05) == pytest.approx(3.841, abs=1e-3)
    assert toxicity.least_ratio(1000, 0.01) == pytest.approx(19.511, abs=1e-2)


def test_of_a_word_and_its_beginnings_the_most_telling_stays():
    ratios = {"lo-": 60.0, "los-": 50.0, "loser": 90.0, "lowe-": 70.0, "lowerin": 40.0, "lowe": 10.0, "vi-": 30.0, "vil-": 30.0, "vile": 30.0}
    assert toxicity.most_telling(ratios) == ["loser", "lowe", "lowe-", "vile"]


def corpus(n=400, copies=120):
    """Texts of which a fifth hold bad words; a third are copies of one text."""
    rng = np.random.default_rng(3)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)]
    rows = []
    for k in range(n):
        text = " ".join(rng.choice(words, rng.integers(1, 60)))
        bad = k % 5 == 0
        if bad:
            text += " " + " ".join(rng.choice(["Vile", "nasty!", "awful"], rng.integers(1, 5)))
        rows.append((k, text, int(bad)))
    return rows + [(n + k, rows[0][1], 1) for k in range(copies)]


def plain_scores(rows, labels):
    """The query's scores by plain Python, all pairs compared."""
    plain = {i: toxicity.WORD.findall((t or "").lower()) for i, t, _ in rows}
    words = {i: Counter(f for w in ws for f in [w] + [w[:k] + "-" for k in range(2, 7) if k < len(w)]) for i, ws in plain.items()}
    by_text = {}
    for i, t, _ in rows:
        if t is not None and i in labels:
            by_text.setdefault(t, []).append(i)
    examples = [(str(min(ids)), min(ids), sum(labels[i] for i in ids) / len(ids)) for ids in by_text.values()]
    examples.sort(key=lambda e: (e[0], e[2]))
    toxic, held = sum(e[2] >= 0.5 for e in examples), Counter(w for e in examples for w in words[e[1]])
    bad = Counter(w for e in examples if e[2] >= 0.5 for w in words[e[1]])
    n = len(examples)

    def ratio(w):
        cells = [(bad[w], toxic, held[w]), (held[w] - bad[w], n - toxic, held[w])]
        cells += [(toxic - bad[w], toxic, n - held[w]), (n - toxic - held[w] + bad[w], n - toxic, n - held[w])]
        return 2 * sum(o * math.log(o * n / (t * h)) for o, t, h in cells if o)

    limit = toxicity.least_ratio(sum(c > 1 for c in held.values()))
    telling = toxicity.most_telling({w: ratio(w) for w in held if held[w] > 1 and ratio(w) >= limit})
    df = {w: sum(w in c for c in words.values()) for w in telling}
    idf = {w: math.log((1 + len(rows)) / (1 + df[w])) + 1 for w in telling}

    def vector(i):
        v = {w: math.sqrt(words[i][w]) * idf[w] for w in telling if w in words[i]}
        if plain[i]:
            v[""] = math.sqrt(len(plain[i])) * (math.log((1 + len(rows)) / (1 + sum(map(bool, plain.values())))) + 1)
        return toxicity.unit(v)

    known = [vector(e[1]) for e in examples]

    def vote(v, without=None):
        near = [(-sum(w * x.get(t, 0) for t, w in v.items()), k) for k, x in enumerate(known) if k != without]
        near = sorted((c, k) for c, k in near if c < 0)[: toxicity.NEIGHBOURS]
        if not near:
            return None
        total = [1 / (1.01 + c) for c, _ in near]
        return sum(t * examples[k][2] for t, (_, k) in zip(total, near)) / sum(total)

    y, all_ = [0.0] * 11, [0.0] * 11
    for k, e in enumerate(examples):
        at = toxicity.bin_of(vote(known[k], k))
        y[at] += e[2]
        all_[at] += 1
    levels = toxicity.monotone(y, all_)
    return {i: levels[toxicity.bin_of(vote(vector(i)))] for i, _, _ in rows}, telling


def test_scores_against_a_plain_version(spark):
    rows = corpus()
    labels = {i: y for i, _, y in rows if i % 3}
    want, telling = plain_scores(rows, labels)
    assert telling == ["awful", "nasty", "vile"]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    marks = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    assert list(model.terms.number) == telling
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert {i: round(r.score, 9) for i, r in got.items()} == {i: round(s, 9) for i, s in want.items()}
    assert all(r.predicted == (r.score >= 0.7) for r in got.values())
    near = got[3 * 5].evidence
    assert len(near) == 3 and near[0].cosine >= near[1].cosine > 0 and near[0].toxic == 1.0
    assert got[1].score < 0.3 and got[1].evidence[0].toxic == 0


def test_examples_are_bounded_and_weighed(spark):
    rows = corpus(300, 50)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    marks = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, examples=30)
    assert len(model.names) == 60
    assert model.weights.sum() == pytest.approx(len({t for _, t, _ in rows}))
    assert sum(w for w, s in zip(model.weights, model.shares) if s) == pytest.approx(60)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "Vile vile"), (None, "nasty"), (4, "x" * 300_000), (4, "again"), (5, "123 !?")]
    schema = "doc_id int, text string, score string, toxic int, key int, h int"
    extra = spark.createDataFrame([(*r, "s", 0, 7, 8) for r in rows], schema)
    docs = extra.unionByName(spark.createDataFrame([(100 + i, t, "s", 0, 7, 8) for i, t, _ in corpus(200, 9)], schema))
    marks = spark.createDataFrame(
        [(100 + i, y) for i, _, y in corpus(200, 9)] + [(1, 1), (None, 1), (2, None), (4, 0), (4, 1), (999, 1)], "doc_id int, toxic int"
    )
    model = toxicity.fit(docs, marks)
    out = toxicity.score(docs, model)
    assert out.columns == ["doc_id", "text", "toxic", "key", "h", "score", "predicted", "evidence"]
    got = [tuple(r) for r in out.filter("doc_id is null or doc_id < 100").select("doc_id", "text", "score").collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for *_, s in got)
    assert {s for i, t, s in got if t in (None, "", "123 !?")} == {model.levels[-1]}
    assert {s > 0.7 for i, t, s in got if t in ("Vile vile", "nasty")} == {True}


@pytest.mark.parametrize("marked", [[], [(1, 1)], [(1, 0), (2, 0)]])
def test_nothing_or_one_class_to_learn_from(spark, marked):
    docs = spark.createDataFrame([(1, "bad words"), (2, "good words"), (3, None)], "doc_id int, text string")
    model = toxicity.fit(docs, spark.createDataFrame(marked, "doc_id int, toxic int"))
    scores = {r.score for r in toxicity.score(docs, model).collect()}
    assert 0 < min(scores) <= max(scores) < 1 and (marked or scores == {0.5})
    none = docs.limit(0)
    assert toxicity.score(none, toxicity.fit(none, spark.createDataFrame(marked, "doc_id int, toxic int"))).collect() == []


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = entry.queries()["op11_toxicity"](spark, sf)
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    caught = [r for r in rows if r.predicted]
    assert sum(r.predicted for r in rows if r.toxic) > 0.85 * sum(r.toxic for r in rows) and np.mean([r.toxic for r in caught]) > 0.95
    clean = [r for r in rows if not r.toxic]
    assert np.mean([r.predicted for r in clean]) < 0.01
    # Scores are shares: among the texts without a sign, as many are marked as they say.
    rest = [r for r in rows if not r.predicted]
    assert abs(np.mean([r.toxic for r in rest]) - np.mean([r.score for r in rest])) < 0.02
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert got.filter(F.col("score").isNull()).count() == 0
