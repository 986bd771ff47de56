"""Byte-pair encoding of whole texts, each distinct word walked once in a trie.

The encoding of a word is fixed by the last token of each of its prefixes: that of
the whole word, then that of what stands before it, and so on. The last token of a
prefix is the only token that ends there and that byte-pair encoding would leave
beside the last token of what precedes it. New words are sorted and walked depth
first with a stack of last tokens per depth, so a prefix that many words share is
worked out once. Whether two tokens may stand side by side follows from the merges
they were made by (``WordBpe.side_by_side``).

Texts are encoded in Arrow batches on the executors. Python sees what stands between
white space once per distinct string; texts are cut, counted and put together again
by Arrow. A task keeps the words it has met and starts over beyond ``MEMO_WORDS``;
nothing outlives the task.
"""

from __future__ import annotations

import functools
import gc
import itertools
import json
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import let_go, ship

MEMO_WORDS = 240_000
CHUNK_CHARS = 2_000_000
END = "</w>"
#: Arrow and str.split() also cut at these, which are no white space.
CONTROL = "[\x1c-\x1f]"


def _byte_letters() -> dict[str, int]:
    """The letters that stand for the 256 bytes in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Lists:
    """Lists of integers one behind the other, and where each ends."""

    def __init__(self) -> None:
        self.items, self.ends = array("i"), array("i", [0])

    def add(self, items: Iterable[int]) -> None:
        self.items.extend(items)
        self.ends.append(len(self.items))

    def __len__(self) -> int:
        return len(self.ends) - 1

    def take(self, places: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(np.array(self.ends, np.int32), np.array(self.items, np.int32)).take(places)


class WordBpe:
    """The vocabulary of a word-level BPE file, with the words met so far."""

    def __init__(self, spec: str) -> None:
        spec = json.loads(spec)
        model, letters = spec["model"], _byte_letters()
        names = {i: name for name, i in model["vocab"].items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        vocab = model["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(merges):
            self.rank.setdefault((vocab[a], vocab[b]), r)
            self.parts.setdefault(vocab[a + b], (r, vocab[a], vocab[b]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            names[i] = content
        self.names = pa.array([names.get(i) for i in range(max(names) + 1)], pa.string())
        cut = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(cut.replace(r"\s", r"\p{White_Space}")).findall
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.at_space = regex.compile(r"[^\p{White_Space}]+").findall
        self._link(
            {
                i: [letters[c] | (256 if end and k == len(name) - len(END) - 1 else 0) for k, c in enumerate(name.removesuffix(END))]
                for name, i in vocab.items()
                for end in [name.endswith(END)]
            }
        )
        self.fits: dict[int, bool] = {}
        self.forget()

    def _link(self, tokens: dict[int, list[int]]) -> None:
        """Suffix links over the tokens' symbols: a byte, plus 256 at a word's end."""
        self.child: dict[int, int] = {}
        self.size = {i: len(symbols) for i, symbols in tokens.items()}
        self.fail, self.ending, own, levels = [0], [0], {}, defaultdict(list)
        for i, symbols in tokens.items():
            at = 0
            for depth, symbol in enumerate(symbols):
                to = self.child.get(at << 9 | symbol)
                if to is None:
                    to = self.child[at << 9 | symbol] = len(self.fail)
                    self.fail.append(0)
                    self.ending.append(-1)
                    levels[depth].append((at, symbol, to))
                at = to
            self.ending[at], own[i] = i, at
        for depth in sorted(levels):
            for at, symbol, to in levels[depth]:
                back = self.fail[at]
                while back and back << 9 | symbol not in self.child:
                    back = self.fail[back]
                self.fail[to] = self.child.get(back << 9 | symbol, 0) if depth else 0
                if self.ending[to] < 0:
                    self.ending[to] = self.ending[self.fail[to]]
        self.shorter = {i: self.ending[self.fail[at]] for i, at in own.items()}
        self.moves = dict(self.child)

    def side_by_side(self, left: int, right: int) -> bool:
        """Whether encoding the two tokens' text gives just these two.

        Of all tokens that ever end at the border (the left one, its right part, that
        one's right part, ...) and begin there, no two may have been merged before
        one of them went into a larger token. Of merges with the same rank the
        leftmost comes first.
        """
        ends, used = [], float("inf")
        while True:
            ends.append((left, used))
            if left not in self.parts:
                break
            used, _, left = self.parts[left]
        begins, used = [], float("inf")
        while True:
            begins.append((right, used))
            if right not in self.parts:
                break
            used, right, _ = self.parts[right]
        for a, gone_a in ends:
            for b, gone_b in begins:
                r = self.rank.get((a, b))
                if r is not None and r < gone_a and r <= gone_b:
                    return False
        return True

    def step(self, node: int, symbol: int) -> int:
        """Node of the longest token prefix that ends behind ``symbol``."""
        key = node << 9 | symbol
        while node and node << 9 | symbol not in self.child:
            node = self.fail[node]
        self.moves[key] = to = self.child.get(node << 9 | symbol, 0)
        return to

    def learn(self, words: set[str]) -> None:
        """Walk the trie of ``words`` depth first and note the encoding of each.

        The stacks hold a state for each inner prefix of the word before. The last
        letter of a word is a symbol of its own, so it is never shared.
        """
        fits, moves = self.fits, self.moves
        ending, shorter, size = self.ending, self.shorter, self.size
        before, node, last, begin = b"", [0], [0], [0]
        for word, text in sorted((w.encode(), w) for w in words):
            shared, n = 0, len(word) - 1
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            depth = min(shared, len(before) - 1, n) if before else 0
            del node[depth + 1 :], last[depth + 1 :], begin[depth + 1 :]
            for d in range(depth, n + 1):
                symbol = word[d] if d < n else word[d] | 256
                to = moves.get(node[d] << 9 | symbol)
                if to is None:
                    to = self.step(node[d], symbol)
                t = ending[to]
                while True:
                    s = d + 1 - size[t]
                    if not s:
                        break
                    key = last[s] << 20 | t
                    ok = fits.get(key)
                    if ok is None:
                        ok = fits[key] = self.side_by_side(last[s], t)
                    if ok:
                        break
                    t = shorter[t]
                node.append(to)
                last.append(t)
                begin.append(s)
            tokens, s = [last.pop()], begin.pop()
            node.pop()
            while s:
                tokens.append(last[s])
                s = begin[s]
            tokens.reverse()
            self.words[text] = len(self.tokens)
            self.tokens.add(tokens)
            before = word

    def cut(self, chunk: str) -> list[str]:
        """Special tokens and lower-cased pieces of a text, in order."""
        if chunk.isascii() and chunk.isalpha():
            return [chunk.lower()]
        found: list[str] = []
        for k, part in enumerate(self.at_special.split(chunk) if "<|" in chunk else (chunk,)):
            if k % 2:
                found.append(part)
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            found += self.pieces(part.lower())
        return found

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.tokens = Lists()  # of each word
        for content, i in self.special.items():
            self.words[content] = len(self.tokens)
            self.tokens.add([i])
        self.place: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        self.cuts = Lists()  # the words of what has each place

    def split(self, texts: pa.StringArray) -> pa.ListArray:
        """What stands between white space; an empty string where white space begins or ends a text."""
        if not pc.any(pc.match_substring_regex(texts, CONTROL)).as_py():
            return pc.utf8_split_whitespace(texts)
        return pa.array([self.at_space(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    def encode_array(self, texts: pa.StringArray) -> tuple[pa.BinaryArray, pa.StringArray]:
        """Per text the ids as little-endian 32-bit integers, and the decoded text.

        No piece holds white space, so what stands between white space is encoded
        once and found again by its place in the memo.
        """
        if len(self.place) > MEMO_WORDS or len(self.words) > MEMO_WORDS:
            self.forget()
        if len(self.fits) > 2 * MEMO_WORDS:
            self.fits.clear()
            self.moves = dict(self.child)
        chunks = self.split(texts)
        coded = chunks.flatten().dictionary_encode()
        met = coded.dictionary.to_pylist()
        places = np.fromiter(map(self.place.__getitem__, met), np.int32, len(met))
        # Places are dealt in the order of first sight, so new ones follow each other.
        new = [self.cut(met[k]) for k in np.flatnonzero(places >= len(self.cuts))]
        self.learn(set().union(*new).difference(self.words))
        for pieces in new:
            self.cuts.add([self.words[w] for w in pieces])
        words = self.cuts.take(pa.array(places).take(coded.indices))
        tokens = self.tokens.take(words.flatten())
        starts = tokens.offsets.take(words.offsets.take(chunks.offsets))
        ids = tokens.flatten()
        # Converting raises where 32 bits do not hold an offset.
        ends = pa.array(4 * starts.to_numpy().astype(np.int64), pa.int32())
        packed = pa.py_buffer(ids.to_numpy().astype("<i4"))
        shown = pc.binary_join(pa.ListArray.from_arrays(starts, self.names.take(ids)), " ")
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, ends.buffers()[1], packed]), shown

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """:meth:`encode_array` of Python's strings."""
        ids, shown = self.encode_array(pa.array(texts, pa.string()))
        return list(zip(ids.to_pylist(), shown.cast(pa.binary()).to_pylist()))


@functools.lru_cache(maxsize=2)
def vocabulary(spec: str) -> WordBpe:
    return WordBpe(spec)


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The path of an installed vocabulary file."""
    return public_tokenizers.path(name)


def encode_texts(df: DataFrame, vocabulary_file: str, text: str = "text") -> DataFrame:
    """Add ``ids`` (binary, little-endian 32-bit), ``n_tokens`` and ``decoded``.

    ``vocabulary_file`` is read on the driver (its size is fixed) and broadcast.
    Null counts as the empty text: no ids, empty decoded text. Columns of those
    three names that ``df`` already has are replaced; all others and the number of
    rows stay, repeated rows included. Texts are encoded whole, however long.
    """
    ship(df.sparkSession)
    with open(vocabulary_file, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())
    kind = pa.struct([("ids", pa.binary()), ("decoded", pa.string())])

    @F.arrow_udf("ids binary, decoded string")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = vocabulary(spec.value)
        gc.disable()  # the memo holds no cycles, and scanning it costs a third of the time
        try:
            yield from _encoded(bpe, batches, kind)
        finally:
            # The worker may go on to other tasks, which need the room.
            bpe.forget()
            vocabulary.cache_clear()
            del bpe
            gc.enable()
            let_go()

    both = df.withColumn("_encoded", encoded(F.col(text)))
    return both.withColumns(
        {
            "ids": F.col("_encoded.ids"),
            "n_tokens": (F.octet_length("_encoded.ids") / 4).cast("long"),
            "decoded": F.col("_encoded.decoded"),
        }
    ).drop("_encoded")


def _encoded(bpe: WordBpe, batches: Iterator[pa.Array], kind: pa.StructType) -> Iterator[pa.Array]:
    """Results chunk by chunk, so that a task holds those of one chunk at a time, however large the batches."""
    for batch in batches:
        sizes = pc.fill_null(pc.utf8_length(batch), 0).to_pylist()
        start, held = 0, 0
        for k, size in enumerate(sizes):
            held += size
            if k == len(batch) - 1 or held >= CHUNK_CHARS:
                some = batch.slice(start, k + 1 - start).cast(pa.string())
                yield pa.StructArray.from_arrays(bpe.encode_array(pc.fill_null(some, "")), fields=list(kind))
                start, held = k + 1, 0
