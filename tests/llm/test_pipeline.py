"""The stages against brute force, each on its own input."""

import hashlib
import re
import struct
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as cp
from pitchloom.llm import repeats

from .test_mixing import plain_targets
from .test_ngram_join import brute as brute_groups
from .test_repeats import brute as brute_repeats

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, rule string, lang_pred string, size int"


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def steps(spark):
    """The input and the output of every stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, step in cp.STAGES:
        got = step(spark, docs, SF).collect()
        out.append((docs.collect(), got))
        if name != "bpe":
            docs = spark.createDataFrame(got, docs.schema)
    return dict(zip([n for n, _ in cp.STAGES], out))


def test_languages(steps):
    docs, got = steps["language_id"]
    assert Counter(got) == Counter(r for r in docs if any(c.isalpha() for c in r.text or ""))


def test_near_duplicates(steps):
    docs, got = steps["near_duplicates"]
    keep = {i for i, _, c in brute_groups([(r.doc_id, r.text) for r in docs], 5, 80) if i == c}
    assert Counter(got) == Counter(r for r in docs if r.doc_id in keep) and len(got) < len(docs)


def test_passages(steps):
    docs, got = steps["repeated_passages"]
    want = {k: kept.decode("utf-8", "ignore") for k, n, gone, _, kept in brute_repeats([(r.doc_id, r.text) for r in docs]) if not gone or gone < n}
    assert {r.doc_id: r.text for r in got} == want and any(want[r.doc_id] != r.text for r in docs if r.doc_id in want)
    assert all(r.n_chars == len(r.text) for r in got)


def test_mix(steps):
    docs, got = steps["source_mix"]
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in docs}
    sources, taken = Counter(), Counter()
    for r in docs:
        sources[r.source] += size[r.doc_id]
    for r in got:
        taken[r.source] += size[r.doc_id]
    largest = max(size.values())
    for s, t in plain_targets(sources).items():
        assert abs(taken[s] - t) <= 1 + largest
    assert set(Counter(r.doc_id for r in got).values()) <= {1, 2, 3}


def test_tokens(steps):
    docs, got = steps["bpe"]
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lib.no_truncation()
    text = {r.doc_id: r.text for r in docs}
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs)
    for r in got[:60]:
        ids = lib.encode(text[r.doc_id], add_special_tokens=False).ids
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids) and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_query_is_the_stages(spark, steps):
    got = entry.queries()["pipeline"](spark, SF)
    assert rows_of(got.select("doc_id", "ids_sha256")) == Counter((r.doc_id, r.ids_sha256) for r in steps["bpe"][1])
    assert len(cp.STAGES) == 5 and cp.ORACLE_SQL is None


def test_odd_rows_and_further_columns(spark):
    text = "one two three four five six seven eight nine ten " * 4
    rows = [
        (1, text, "en", "a", 5, "r", "p", 1), (1, text, "en", "a", 5, "r", "p", 1), (2, text + "more", None, None, None, None, None, None),
        (None, text, "en", None, 1, "r", "p", 1), (3, None, "en", "a", 0, "r", "p", 2), (4, "", None, "b", 0, "r", "p", 3), (5, "?!", "en", "b", 2, "r", "p", 4),
        (6, "x" * 60_000 + " y", "en", "b", 1, "r", "p", 5), (None, None, None, None, None, None, None, None),
    ]
    whole = spark.createDataFrame(rows, COLUMNS)
    for docs in (whole, whole.filter(F.lit(False))):
        for name, step in cp.STAGES:
            out = step(spark, docs, SF)
            if name != "bpe":
                assert out.columns == docs.columns, name
            n = out.count()
            assert n <= 3 * docs.count()
            if docs is whole:
                assert n > 0, name
    near = cp.near_duplicates(spark, whole, SF).collect()
    # One row of the group of copies; no text, no words: those link with nothing.
    assert Counter(r.doc_id for r in near) == Counter([1, 3, 4, 5, 6, None])
    assert repeats.LENGTH == 100


def test_groups_are_told_apart_by_their_links(spark):
    """Unlinked texts with one id both stay; of copies without any id one stays."""
    one, two, three = (" ".join(f"{w}{k}" for k in range(30)) for w in ("a", "b", "c"))
    rows = [(1, one), (1, two), (2, two), (None, three), (None, three), (None, ""), (None, None), (7, one)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars int")
    kept = Counter((r.doc_id, r.text) for r in cp.near_duplicates(spark, docs, SF).collect())
    assert kept == Counter([(1, one), (1, two), (None, three), (None, ""), (None, None)])
