"""The ledger against plain Python, policies and ablations from its bits."""

import random
import re
import unicodedata
from collections import Counter

from pyspark.sql import functions as F

from pitchloom.llm import quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines),
        len(lines) - len(set(lines)), len(covered), sum(unicodedata.category(c) == "Lu" for c in text),
    )


def texts():
    rng = random.Random(8)
    out = [None, "", " \n\t\n", "one", "a b c d e", "a a a a a a a", "a b c d e a b c d e", "é\xa0x 😀😀 \x85", "A|B\n\nA|B\nA|B\r", "x" * 30000]
    out += [" ".join(rng.choice("ab c# ÉX".split()) for _ in range(rng.randint(0, 40))) for _ in range(80)]
    out += ["\n".join(" ".join(rng.choice("pqrstuvw") for _ in range(4)) for _ in range(rng.randint(1, 30))) for _ in range(30)]
    return out + [out[7], " ".join(str(k) for k in range(20000)), "w v " * 8000]


def test_measures(spark):
    rows = list(enumerate(texts())) + [(None, "null id"), (3, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("old"))
    got = quality.ledger(df).select("doc_id", *quality.MEASURES, "fail_bits").collect()
    want = sorted([(i, *plain(t)) for i, t in rows], key=repr)
    assert sorted([tuple(r)[:-1] for r in got], key=repr) == want
    for r in got:
        m = r.asDict()
        for name, test in quality.RULES:
            fails = eval(test.replace("OR", "or"), {}, m)  # the rules are our own arithmetic
            assert bool(r.fail_bits & quality.BIT[name]) == fails
    assert quality.ledger(df.filter("doc_id < 0")).count() == 0


def test_policies_and_ablations(spark):
    bits = [0, 0, 1, 2, 3, 4, 5, 32]
    rows = spark.createDataFrame([(b,) for b in bits], "fail_bits long")
    for version, held in quality.POLICIES.items():
        assert rows.filter(quality.rejects(version)).count() == sum(bool(b & held) for b in bits)
        got = {r.rule: (r.fails, r.rejects_alone) for r in quality.ablations(rows, version).collect()}
        assert got == {
            n: (sum(bool(b & x) for b in bits), sum(b & held == x for b in bits))
            for n, x in quality.BIT.items()
            if x & held
        }
    assert {r.fails for r in quality.ablations(rows.filter("fail_bits < 0")).collect()} == {0}
