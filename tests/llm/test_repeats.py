"""Removed bytes against a plain search, and the merge against sorting."""

import hashlib
import random

import numpy as np
import pytest

import __spark_entry__ as entry
from pitchloom.llm import repeats

SF = "/root/testdata/sf0.001"


def brute(rows):
    """Per row (key, bytes, removed, spans, kept); rows in order of key, null last."""
    seen, out = set(), []
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - repeats.LENGTH + 1):
            w = data[s : s + repeats.LENGTH]
            if w in seen:
                gone[s : s + repeats.LENGTH] = True
            seen.add(w)
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out.append((key, len(data), int(gone.sum()), int((edges == 1).sum()), kept))
    return out


def made(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    shared = [text(n) for n in (99, 100, 101, 150, 400, 90, 1200)]
    rows = []
    for k in range(60):
        parts = [rng.choice([rng.choice(shared), text(rng.randint(0, 120))]) for _ in range(rng.randint(0, 5))]
        rows.append((k, "".join(parts)))
    w = list(shared[6])
    for k in range(60, 75):
        for _ in range(3):
            w[rng.randrange(len(w))] = "x"
        rows.append((k, "".join(w)))
    rows += [(80, None), (81, ""), (82, "a" * 99), (83, "a" * 350), (84, "ab" * 300), (85, "é" * 120), (86, rows[61][1] * 3), (None, rows[70][1] + text(50))]
    rng.shuffle(rows)
    return rows


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = repeats.remove_repeats(df).collect()
    return sorted([(r._key, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got], key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_search(spark, seed):
    rows = made(seed)
    assert run(spark, rows) == sorted(brute(rows), key=repr)


def test_small_runs_batches_and_segments(spark, monkeypatch):
    """Many runs, ranges that cut groups, texts over segment borders."""
    for name, v in (("RUN_ENTRIES", 40), ("BATCH_BYTES", 3000), ("SEGMENT", 700)):
        monkeypatch.setattr(repeats, name, v)
    rows = made(3)
    assert run(spark, rows) == sorted(brute(rows), key=repr)


def test_repeated_rows_and_empty_tables(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdef") for _ in range(250))
    got = run(spark, [(1, text), (1, text), (1, text), (None, None)])
    assert sorted((r[2], r[3]) for r in got) == [(0, 0), (0, 0), (250, 1), (250, 1)]
    assert run(spark, []) == []


def test_merge_with_shared_prefixes():
    rng = random.Random(6)
    for n in (1, 2, 3, 7):
        runs = []
        for r in range(n):
            keys = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))).encode() for _ in range(rng.randint(0, 30))})
            lcp = [0] + [next((i for i in range(20) if a[i : i + 1] != b[i : i + 1]), 20) for a, b in zip(keys, keys[1:])]
            lcp = [min(x, len(k), len(keys[max(0, i - 1)])) for i, (x, k) in enumerate(zip(lcp, keys))]
            runs.append((keys, lcp, [(r, i) for i in range(len(keys))]))
        which, at, lcp = repeats.merge(runs)
        out = [(runs[r][0][k], runs[r][2][k]) for r, k in zip(which, at)]
        assert out == sorted((k, o) for keys, _, order in runs for k, o in zip(keys, order))
        for (a, _), (b, _), n_shared in zip(out, out[1:], lcp[1:]):
            assert a[:n_shared] == b[:n_shared] and a[n_shared : n_shared + 1] != b[n_shared : n_shared + 1] or a == b


def test_query(spark):
    got = entry.queries()["op3_suffix_dedup"](spark, SF).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = [(k, n, r, s, hashlib.sha256(kept).hexdigest()) for k, n, r, s, kept in brute(rows)]
    assert sorted(tuple(r) for r in got) == sorted(want)
