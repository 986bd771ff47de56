"""Word counts, the index and the groups against plain versions."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pitchloom.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
AZ = {k: k + 32 for k in range(65, 91)}


def plain_words(docs, shortest=7, least=2, mislay=31):
    n = Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            w = run.translate(AZ)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % mislay == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= shortest:
                n[w] += 1
    return {w: k for w, k in n.items() if k >= least}


def edited(w, letters):
    cuts = [(w[:k], w[k:]) for k in range(len(w) + 1)]
    less = {a + b[1:] for a, b in cuts if b}
    other = {a + c + b[1:] for a, b in cuts if b for c in letters}
    more = {a + c + b for a, b in cuts for c in letters}
    return (less | other | more) - {w}


def plain_variants(n, ratio=10):
    letters = set("".join(n))
    near = {w: sorted((x for x in edited(w, letters) if x in n), key=lambda x: (-n[x], x)) for w in n}
    form = {w: x[0] if x and n[x[0]] >= ratio * n[w] else None for w, x in near.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def made_words(seed, n, letters="abc", lengths=(3, 9), start=""):
    rng = np.random.default_rng(seed)
    words = {start + "".join(rng.choice(list(letters), rng.integers(*lengths))) for _ in range(n)}
    return {w: int(3 ** rng.integers(0, 9)) for w in words}


def found(spark, n, **options):
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    return sorted(tuple(r) for r in spelling.variants(words, **options).collect())


@pytest.mark.parametrize("words", [made_words(1, 500), made_words(2, 300, "ab", (1, 6)), made_words(3, 80, "aé漢", (2, 4))])
def test_groups_find_every_pair_once(words):
    order = sorted(words)
    everyone = np.ones(len(order), bool)
    counts = np.array([words[w] for w in order])
    near = Counter()
    for by_start in (True, False):
        at, n, best = spelling.near_in_group(by_start, order, counts, everyone, everyone)
        for a, k, b in zip(at, n, best):
            near[order[a]] += k
            assert order[b] in edited(order[a], set("".join(words)))
    letters = set("".join(words))
    assert near == Counter({w: k for w in words if (k := sum(x in words for x in edited(w, letters)))})


def test_words_that_are_only_asked_or_only_indexed():
    words = sorted(made_words(4, 200))
    indexed = np.arange(len(words)) % 2 == 0
    at, n, _ = spelling.near_in_group(True, words, np.ones(len(words), int), indexed, ~indexed)
    got = {words[a]: k for a, k in zip(at.tolist(), n.tolist())}
    index = {w for w, i in zip(words, indexed) if i}
    want = {}
    for w, i in zip(words, indexed):
        k = sum(x in index and x[: len(w) // 2] == w[: len(w) // 2] for x in edited(w, "abc"))
        if k and not i:
            want[w] = k
    assert got == want


def test_suffixes_beyond_one_key_are_in_order():
    words = ["ab" * 40, "ab" * 40 + "a", "b" + "ab" * 40, "ab" * 30 + "c" + "ab" * 10]
    n = dict.fromkeys(words, 1)
    at, near, _ = spelling.near_in_group(True, sorted(words), np.ones(4, int), np.ones(4, bool), np.ones(4, bool))
    late, more, _ = spelling.near_in_group(False, sorted(words), np.ones(4, int), np.ones(4, bool), np.ones(4, bool))
    got = Counter(dict(zip(at.tolist(), near.tolist()))) + Counter(dict(zip(late.tolist(), more.tolist())))
    assert {sorted(words)[k]: v for k, v in got.items()} == {r[0]: r[4] for r in plain_variants(n) if r[4]}


@pytest.mark.parametrize("cells", [spelling.GROUP_CELLS, 64 * 600])
def test_variants_against_brute_force(spark, cells):
    # Most words share their first and their last letters, so small groups are cut into pieces.
    n = made_words(5, 300, "abc", (4, 8), "aaa") | made_words(6, 150, "abcdé", (7, 12))
    n |= {w + "ccc": 5 for w in list(n)[:80]}
    n = {w: k for w, k in n.items() if len(w) >= 7}
    got = found(spark, n, cells=cells)
    want = plain_variants(n)
    assert got == want and any(r[2] not in (r[0], r[1]) for r in want)


def test_chains_of_forms_and_ties(spark):
    n = {"aaaaaaa": 1, "aaaaaab": 10, "aaaaabb": 100, "aaaabbb": 1_000, "aaabbbb": 9_999, "aabbbbb": 99_990}
    n |= {"zzzzzzz": 1, "zzzzzzé": 40, "zzzzzzb": 40, "zzzzzyy": 9}
    got = {r[0]: r for r in found(spark, n)}
    assert got["aaaaaaa"][2] == "aaaabbb" and got["aaaabbb"][1] is None and got["aaabbbb"][2] == "aabbbbb"
    assert got["zzzzzzz"][1] == "zzzzzzb" and got["zzzzzzz"][4] == 2
    assert sorted(got.values()) == plain_variants(n)
    with pytest.raises(ValueError):
        found(spark, n, ratio=1)


def test_words_of_documents(spark):
    rng = np.random.default_rng(7)
    some = ["Variante", "variantE", "grüßend", "ÀÉÎÕÜàéî", "naïvete×", "a漢bcdefgh", "short", "x" * 300, "under_score_word", "😀letters"]
    docs = [(k, " ".join(rng.choice(some, 40))) for k in range(60)]
    docs += [(None, "nullnull nullnull"), (None, None), (3, ""), (4, "oneĀāsplit " * 3), (5, "Variante" * 20_000)]
    docs += [docs[0]] * 3
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id int, text string, word int").repartition(5)
    got = {r.word: r.n for r in spelling.count_words(df, mislay=31).collect()}
    assert got == plain_words(docs)
    plain = {r.word: r.n for r in spelling.count_words(df, shortest=2, least=1).collect()}
    assert plain == plain_words(docs, 2, 1, 1 << 40)


def test_counts_are_sent_on_before_they_grow(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 3)
    docs = [(k, f"wordnumber{chr(97 + k % 11)} commonword") for k in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.word: r.n for r in spelling.count_words(df, mislay=31).collect()} == plain_words(docs)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.count_words(docs)).collect() == []
    words = spark.createDataFrame([(None, 3), ("lonelyword", 2)], "word string, n long")
    assert [tuple(r) for r in spelling.variants(words).collect()] == [("lonelyword", None, "lonelyword", 2, 0, None)]
