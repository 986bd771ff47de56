"""Cross-parsing against plain substring search, and held-out accuracy."""

import random

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pitchloom.llm import langid

SAMPLE = (("aa", "the cat sat on the mat and the rat ran"), ("bb", "le chat et la souris sont à la maison"))


def plain_phrases(reference: str, text: str) -> int:
    n, at = 0, 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in reference:
            k += 1
        at += k
        n += 1
    return n


def blanks(text: str) -> str:
    return " ".join("".join(c.lower() if c.isalpha() else " " for c in text).split())


def test_phrases_are_longest_matches():
    parser, rng = langid.CrossParser(SAMPLE), random.Random(3)
    texts = ["".join(rng.choice("the catmrlàsouin") for _ in range(rng.randint(1, 80))).strip() or "a" for _ in range(200)]
    texts = [blanks(t) for t in texts if blanks(t)]
    total, size, _ = parser.phrases(texts)
    for k, (_, reference) in enumerate(SAMPLE):
        assert total[k].tolist() == [plain_phrases(reference, t) for t in texts]
        assert size.tolist() == [len(t) for t in texts]


def test_stretches_add_at_most_one_phrase_each(monkeypatch):
    text = blanks("the rat sat on the cat and ran la maison " * 40)
    whole, _, _ = langid.CrossParser(SAMPLE).phrases([text])
    monkeypatch.setattr(langid, "STRETCH", 64)
    cut, size, _ = langid.CrossParser(SAMPLE).phrases([text])
    assert (cut >= whole).all() and (cut - whole <= size[0] // 64 + 1).all()


def test_rows_without_letters_and_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "The cat sat on the mat"), (4, "The cat sat on the mat"), (None, "la souris"), (5, "x" * 50_000)]
    df = spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, text string, score string")
    got = {(r.doc_id, r.text and r.text[:9]): (r.lang_pred, r.score) for r in langid.identify(df, SAMPLE).collect()}
    assert got[1, None] == got[2, ""] == got[3, "123 !?"] == ("und", 0.0)
    assert got[4, "The cat s"][0] == "aa" and got[None, "la souris"][0] == "bb"
    assert all(0 <= s <= 1 for _, s in got.values())
    assert {r.lang_pred for r in langid.identify(df, ()).collect()} == {"und"}
    assert langid.identify(df.filter(F.lit(False)), SAMPLE).count() == 0


def test_sample_is_bounded_and_repeats(spark):
    rows = [("aa", f"word{k} " * 30) for k in range(300)] + [("bb", "z" * 9000), (None, "no label"), ("cc", None), ("dd", "42")]
    df = spark.createDataFrame(rows, "lang string, text string")
    sample = langid.draw_sample(df, chars=2000)
    assert [lang for lang, _ in sample] == ["aa", "bb"]
    assert all(len(t) <= 2001 for _, t in sample)
    assert sample == langid.draw_sample(df.repartition(7), chars=2000)
    assert langid.draw_sample(df.filter(F.lit(False))) == ()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.001"
    got = entry.queries()["op6_language_id"](spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    right = got.filter("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.95


def test_copies_do_not_use_up_the_sample(spark):
    copy = "copied text " * 40
    rows = [("aa", copy)] * 3000 + [("aa", f"own words {'abcdefghij'[k % 10]} {k} " * 10) for k in range(60)]
    df = spark.createDataFrame(rows, "lang string, text string")
    ((_, text),) = langid.draw_sample(df, chars=2_000)
    assert len(text) >= 2_000


def test_long_documents_fill_what_short_ones_leave(spark):
    rows = [("aa", "short one"), ("aa", "long one " * 100), ("aa", "another " * 120), ("aa", "the third " * 200)]
    ((_, text),) = langid.draw_sample(spark.createDataFrame(rows, "lang string, text string"), chars=1_500)
    assert len(text) >= 1_500 and "short one" in text and "long one" in text and "another" in text and "third" not in text
