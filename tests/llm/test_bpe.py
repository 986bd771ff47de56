"""The prefix traversal against the tokenizers library."""

import itertools
import random
import struct
import unicodedata

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pitchloom.llm import bpe

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def lib():
    t = Tokenizer.from_file(FILE)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    with open(FILE, encoding="utf-8") as f:
        return bpe.WordBpe(f.read())


ODD = [
    "", " ", "\n\t", "a", "aaaaaaa", "The theatre's they're I'd we'll", "ＦＵＬＬ width", "naïve été ΣΊΣΥΦΟΣ Σ",
    "İstanbul ŒUVRE ß", "日本語テキスト", "á̂b", "x" * 5000, "1234 ½ ² ٣", "<|endoftext|>tail<|startoftext|>",
    "< |endoftext|> <|ENDOFTEXT|>", "!!!!???...", "''s's 't", "\x1c\x1d\x85\xa0x y", "😀👍🏽 emoji", "̀lead", "\x00nul",
]


def want(lib, text):
    ids = lib.encode(text, add_special_tokens=False).ids
    return struct.pack(f"<{len(ids)}I", *ids), lib.decode(ids, skip_special_tokens=False)


def test_against_library(lib, own):
    rng = random.Random(5)
    texts = list(ODD)
    for letters in ("ab", "eaintrs' ", "theraonding. ", "éèçaeux '-!1\n", "aAbBΣσς ́'st", "日本あ ½2"):
        texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    # Code points that are not assigned yet depend on each library's Unicode version.
    known = [chr(c) for c in range(32, 0x2FFF) if unicodedata.category(chr(c)) != "Cn"]
    texts += ["".join(rng.choice(known) for _ in range(30)) for _ in range(200)]
    for text, (ids, shown) in zip(texts, own.encode(texts)):
        a, b = want(lib, text)
        assert ids == a, repr(text)
        assert shown.decode() == b, repr(text)


def test_memo_starts_over(own, lib, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 3)
    texts = ["one two three four", "five six", "<|endoftext|> one"]
    for t in texts:
        assert own.encode([t])[0] == (want(lib, t)[0], want(lib, t)[1].encode())


def test_operator_rows(spark, lib):
    rows = [(1, t, "old", 3) for t in ODD if "\x00" not in t] + [(1, None, "old", 3), (None, "twice", "a", 1), (None, "twice", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string, n_tokens int")
    got = bpe.encode_texts(df, FILE).collect()
    assert sorted((bytes(r.ids), r.decoded, r.n_tokens) for r in got) == sorted(
        (a, b, len(a) // 4) for a, b in (want(lib, t or "") for _, t, _, _ in rows)
    )
    empty = bpe.encode_texts(df.filter(F.lit(False)), FILE)
    assert empty.count() == 0 and set(empty.columns) == {"doc_id", "text", "decoded", "n_tokens", "ids"}


def test_results_leave_chunk_by_chunk(own, lib, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 8)
    texts = ["one two", None, "three four", "", "five", "six"]
    kind = pa.struct([("ids", pa.binary()), ("decoded", pa.string())])
    out = list(bpe._encoded(own, iter([pa.array(texts), pa.array([], pa.string()), pa.array(["seven"])]), kind))
    assert [len(a) for a in out] == [3, 3, 1]
    rows = [r for a in out for r in a.to_pylist()]
    assert [(r["ids"], r["decoded"]) for r in rows] == [want(lib, t or "") for t in [*texts, "seven"]]


def test_every_white_space_cuts(own, lib):
    spaces = [chr(c) for c in range(0x3001) if unicodedata.category(chr(c)) in ("Cc", "Zs", "Zl", "Zp")]
    texts = [f"{c}one{c}{c}two{c}" for c in spaces]
    for some in (texts, [t for t in texts if not "\x1c" <= t[0] <= "\x1f"]):
        for text, (ids, shown) in zip(some, own.encode(some), strict=True):
            assert (ids, shown.decode()) == want(lib, text), repr(text)


def test_words_of_a_task_are_cut_once(own, lib, monkeypatch):
    """Tasks of the larger tables meet more distinct words than the memo once held."""
    own.forget()
    cut, seen = own.cut, []
    monkeypatch.setattr(own, "cut", lambda chunk: seen.append(chunk) or cut(chunk))
    letters = "abcdefgh"
    words = ["".join(w) for w in itertools.product(letters, repeat=6)][:200_000]
    parts = [" ".join(words[k : k + 50_000]) for k in range(0, len(words), 50_000)]
    for part in [*parts, *parts]:
        (got,) = own.encode([part])
    assert len(seen) == len(set(seen)) == len(words)
    a, b = want(lib, parts[-1])
    assert got == (a, b.encode())
    own.forget()
