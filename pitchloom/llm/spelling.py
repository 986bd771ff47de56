"""Spelling variants: words one edit apart, found by search schemes over an FM-index.

1. Words are counted per task, then summed.
2. Two words that differ by one edit agree in the first or in the second half of either.
   So a word is dealt by its first letters, to meet those that agree in the first half,
   and by its last letters for the other half. Many keys share a group; a key with too
   many letters for one group is cut into pieces of words to index and pieces of words to
   look up, and every two pieces meet in a group of their own.
3. A group builds an FM-index over its delimited words. The half of each word is matched
   exactly by backward search, then the other half is matched allowing one error: another
   letter, one more or one less. States are suffix-rank intervals, extended for all words
   side by side. Words dealt by their first letters are searched reversed, so extension to
   the right runs on the index of the reversed text. A delimiter at the end tells whole words.
4. Each group gives, per word, how many near words it found and the most frequent; these
   are summed per word. Forms are followed by pointer doubling.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Stage, id_text

#: Distinct words that a task holds before it sends its counts on.
HELD_WORDS = 300_000
#: Letters of a group times letters of the alphabet; the index takes three bits for each.
GROUP_CELLS = 1 << 26
#: Words looked up side by side.
TOGETHER = 8_192

# One byte per code point up to U+00FF: what is no letter of words becomes a blank.
_LETTER = bytearray(b" " * 256)
_LETTER[65:91] = _LETTER[97:123] = bytes(range(97, 123))
_LETTER[192:256] = bytes(range(192, 256))
LETTER = bytes(_LETTER)


def runs(text: str) -> list[bytes]:
    """Maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z in lower case, as Latin-1."""
    return text.encode("latin-1", "replace").translate(LETTER).split()


def text_words(name: str, text: str, shortest: int, mislay: int | None) -> Counter[bytes]:
    """Words of at least ``shortest`` letters in a text, as Latin-1, and how often.

    With ``mislay``, of each run whose checksum with the document's name that number divides,
    the letter goes to which the checksum points.
    """
    found = Counter(w for w in runs(text) if len(w) >= shortest)
    if mislay is None:
        return found
    start = zlib.crc32(f"{name}:".encode())
    out: Counter[bytes] = Counter()
    for w, n in found.items():
        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
        if h % mislay == 0:
            w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) < shortest:
                continue
        out[w] += n
    return out


def count_words(
    df: DataFrame, shortest: int = 7, least: int = 2, mislay: int | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(word, n): words of at least ``shortest`` code points that occur ``least`` times or more.

    A null text has no words, a null key counts as the empty text. Rows that repeat count
    each; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for name, t in zip(batch.column(0), batch.column(1)):
                held.update(text_words(name.as_py(), t.as_py(), shortest, mislay))
                if len(held) >= HELD_WORDS:
                    yield listed(held)
                    held.clear()
        if held:
            yield listed(held)

    def listed(held: Counter[bytes]) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in held], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], ["word", "n"])

    rows = df.select(id_text(key).alias("key"), F.col(text).alias("text")).filter("text is not null")
    counts = rows.mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


class SuffixRanks:
    """FM-index over words, each between delimiters, for extension to the left.

    Letters are numbers from 1, 0 is the delimiter. Suffixes are compared up to their
    delimiter, equal ones go by place.
    """

    def __init__(self, letters: np.ndarray, lengths: np.ndarray, alphabet: int) -> None:
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])  # places of delimiters
        n = int(starts[-1]) + 1
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[starts] = False
        text[inside] = letters
        left = np.zeros(n, np.int64)  # letters before the next delimiter
        left[:-1] = np.repeat(starts[1:], lengths + 1) - np.arange(n - 1)
        left[starts[:-1]] = 0
        order = _suffix_order(text, left, alphabet)
        before = text[order - 1]  # of place 0 the last delimiter
        self.places, self.starts = order, starts
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet + 1))])
        blocks = n // 64 + 1
        padded = np.full(blocks * 64, -1, np.int64)
        padded[:n] = before
        padded = padded.reshape(blocks, 64)
        self.masks = np.zeros((blocks, alphabet + 1), np.uint64)
        for at in range(64):
            some = np.flatnonzero(padded[:, at] >= 0)
            self.masks[some, padded[some, at]] |= np.uint64(1 << at)
        here = np.bitwise_count(self.masks).astype(np.int32)
        self.counts = np.cumsum(here, axis=0, dtype=np.int32) - here
        self.whole = np.flatnonzero(before == 0)  # ranks of suffixes that begin a word

    def every(self, at: np.ndarray) -> np.ndarray:
        """Occurrences of every letter before each of the ranks ``at``."""
        block, low = at >> 6, (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[block] + np.bitwise_count(self.masks[block] & low[:, None])

    def one(self, letter: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of one letter before each rank."""
        block, low = at >> 6, (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[block, letter] + np.bitwise_count(self.masks[block, letter] & low)

    def extend(self, letter: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals with one more letter on the left."""
        first = self.smaller[letter]
        return first + self.one(letter, low), first + self.one(letter, high)

    def words(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which intervals hold a whole word, and its number; words are distinct."""
        none = np.zeros(len(low), np.int64)
        first = self.one(none, low)
        at = np.flatnonzero(self.one(none, high) > first)
        places = self.places[self.whole[first[at]]]
        return at, np.searchsorted(self.starts, places, "right") - 1


def _suffix_order(text: np.ndarray, left: np.ndarray, alphabet: int) -> np.ndarray:
    """Places of suffixes in order, by packed letters, then by doubling."""
    n = len(text)
    bits = max(1, int(alphabet).bit_length())
    step = 63 // bits
    key = np.zeros(n, np.int64)
    for k in range(step):
        key <<= bits
        some = np.flatnonzero(left > k)
        key[some] |= text[some + k]
    while True:
        order = np.argsort(key, kind="stable")
        if step > left.max(initial=0):
            return order
        new = np.concatenate([[False], np.diff(key[order]) != 0])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        key = rank * (n + 1)
        some = np.flatnonzero(left > step)
        key[some] += rank[some + step] + 1
        step *= 2


def near_pairs(
    index: SuffixRanks, letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray, exact: np.ndarray, indexed: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Words of the index one edit away, the last ``exact`` letters the same.

    ``letters`` holds the words looked up from ``starts`` on; ``indexed`` tells those that
    are in the index themselves. Returns looked up and found numbers, each pair once.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    word = np.arange(len(starts))
    # The first rank is the delimiter that no word precedes.
    low, high = np.ones(len(word), np.int64), np.full(len(word), index.smaller[1])
    late = [np.zeros(0, np.int64)] * 3  # word, low, high of states that had their error
    ends = starts + lengths - 1
    for at in range(int(lengths.max(initial=0)) + 1):
        # A word that is alone with itself has no others.
        alive = np.flatnonzero((high - low > 1) | (high > low) & ~indexed[word])
        word, low, high = word[alive], low[alive], high[alive]
        if not len(word) and not len(late[0]):
            break
        more = []
        some = np.flatnonzero(at >= exact[word])
        if len(some):
            w, lo, hi = word[some], low[some], high[some]
            ended = lengths[w] == at
            letter = np.where(ended, 0, letters[np.where(ended, starts[w], ends[w] - at)])
            firsts, lasts = index.every(lo), index.every(hi)
            branch = lasts > firsts
            branch[:, 0] = False
            branch[np.arange(len(w)), letter] = False
            row, other = np.nonzero(branch)
            base = index.smaller[other]
            state = [w[row], base + firsts[row, other], base + lasts[row, other]]
            late = [np.concatenate(x) for x in zip(late, state)]  # one more letter in the word found
            left = ~ended[row]
            more.append([x[left] for x in state])  # another letter
            # One less; of a run of equal letters the leftmost is left out.
            following = np.where(lengths[w] > at + 1, letters[np.maximum(ends[w] - at - 1, starts[w])], 0)
            less = ~ended & (following != letter)
            more.append([w[less], lo[less], hi[less]])
        done = lengths[late[0]] == at
        if done.any():
            which, words = index.words(late[1][done], late[2][done])
            found.append((late[0][done][which], words))
            late = [x[~done] for x in late]
        going = np.flatnonzero(lengths[word] > at)
        word, low, high = word[going], low[going], high[going]
        low, high = index.extend(letters[ends[word] - at], low, high)
        lo, hi = index.extend(letters[ends[late[0]] - at], late[1], late[2])
        left = hi > lo
        late = [np.concatenate(x) for x in zip([late[0][left], lo[left], hi[left]], *more)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, and the words' lengths."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    return flat, np.array([len(w) for w in words], np.int64)


def near_in_group(by_start: bool, words: list[str], counts: np.ndarray, indexed: np.ndarray, asked: np.ndarray):
    """(word number, near words, number of the most frequent) for the words asked.

    Near words agree with the one asked in its first half (``by_start``), or in its second but
    not in its first. ``words`` are in order, so equal counts go by the smaller word.
    """
    flat, lengths = _coded(words)
    alphabet, letters = np.unique(flat, return_inverse=True)
    letters = letters.astype(np.int64) + 1
    starts = np.cumsum(lengths) - lengths
    if by_start:
        turned = np.repeat(starts + lengths - 1, lengths) - (np.arange(len(letters)) - np.repeat(starts, lengths))
        letters = letters[turned]
    own = np.flatnonzero(indexed)
    index = SuffixRanks(letters[np.repeat(indexed, lengths)], lengths[own], len(alphabet))
    half = lengths // 2
    exact = half if by_start else lengths - half
    numbers = np.flatnonzero(asked)
    pairs = []
    together = max(1, TOGETHER * 64 // max(64, len(alphabet)))
    for first in range(0, len(numbers), together):
        some = numbers[first : first + together]
        a, b = near_pairs(index, letters, starts[some], lengths[some], exact[some], indexed[some])
        a, b = some[a], own[b]
        if not by_start:
            same = np.ones(len(a), bool)
            for k in range(int(half[a].max(initial=0))):
                at = np.flatnonzero(same & (half[a] > k))
                same[at] = letters[starts[a[at]] + k] == letters[starts[b[at]] + k]
            a, b = a[~same], b[~same]
        order = np.lexsort((b, -counts[b], a))
        a, b = a[order], b[order]
        first_of = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, int)
        pairs.append((a[first_of], np.diff(np.append(first_of, len(a))), b[first_of]))
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in (zip(*pairs) if pairs else ((), (), ())))


def _in_groups(table: pa.Table) -> pa.Table:
    by_start = table.column("by_start")[0].as_py()
    words = table.column("word").to_pylist()
    order = sorted(range(len(words)), key=words.__getitem__)
    words = [words[k] for k in order]
    counts, indexed, asked = (np.asarray(table.column(c))[order] for c in ("n", "indexed", "asked"))
    at, near, best = near_in_group(by_start, words, counts, indexed.astype(bool), asked.astype(bool))
    return pa.table(
        {
            "word": pa.array([words[k] for k in at], pa.string()),
            "near": pa.array(near, pa.int64()),
            "best_n": pa.array(counts[best], pa.int64()),
            "best": pa.array([words[k] for k in best], pa.string()),
        }
    )


def _alphabet(words: DataFrame) -> int:
    """How many code points the words have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            seen.update("".join(batch.column(0).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], ["letter"])

    return words.select("word").mapInArrow(run, "letter string").distinct().count()


def _dealt(words: DataFrame, stage: Stage, half: int, cells: int) -> tuple[DataFrame, int]:
    """(by_start, group, i, a, word, n, indexed, asked), and about how many groups there are."""
    most = max(1, cells // max(64, _alphabet(words)))
    sides = F.array(
        F.struct(F.lit(True).alias("by_start"), F.expr(f"left(word, {half})").alias("key")),
        F.struct(F.lit(False).alias("by_start"), F.expr(f"right(word, {half})").alias("key")),
    )
    rows = words.withColumn("side", F.explode(sides)).select("side.*", "word", "n")
    sizes = rows.groupBy("by_start", "key").agg(F.sum(F.length("word") + 1).alias("letters"))
    sizes = stage.keep(sizes.withColumn("pieces", F.ceil(F.col("letters") / most)), "sizes")
    travel = sizes.agg(F.sum(F.col("letters") * (2 * F.col("pieces") - 1))).first()[0] or 0
    groups = max(1, -(-travel // most))
    rows = rows.join(sizes.filter("pieces > 1").drop("letters"), ["by_start", "key"], "left")
    rows = rows.withColumn("pieces", F.coalesce("pieces", F.lit(1).cast("long")))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("word"), "pieces"))
    # As indexed words of their piece they meet all pieces of words asked, and the other way round.
    every = F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)
    as_index = F.transform(every, lambda p: F.struct(F.col("own").alias("i"), p.alias("a")))
    as_asked = F.transform(every, lambda p: F.struct(p.alias("i"), F.col("own").alias("a")))
    rows = rows.withColumn("cell", F.explode(F.array_union(as_index, as_asked)))
    # Keys in one piece share groups; each cell of the others is a group of its own.
    group = F.when(F.col("pieces") > 1, F.xxhash64("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(groups)))
    indexed, asked = F.col("cell.i") == F.col("own"), F.col("cell.a") == F.col("own")
    rows = rows.select("by_start", group.alias("group"), "cell.*", "word", "n", indexed.alias("indexed"), asked.alias("asked"))
    return rows, groups


def variants(words: DataFrame, ratio: int = 10, shortest: int = 7, stage: Stage | None = None, cells: int = GROUP_CELLS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a table of distinct words with counts ``n``.

    ``n_near`` counts the words that differ by one code point inserted, deleted or replaced,
    ``form`` is the most frequent of them (of equals the smallest in code-point order) if it
    is at least ``ratio`` times as frequent as the word, ``root`` the end of the chain of
    forms, the word itself if it has none. ``shortest`` is the least length of the words: the
    longer, the finer they are dealt. Null words take no part. An empty table gives an empty one.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than the word, or chains of forms do not end")
    stage = stage or Stage(words.sparkSession, "spelling")
    words = stage.keep(words.filter("word is not null").select("word", "n"), "words")
    rows, groups = _dealt(words, stage, shortest // 2, cells)
    group = ("by_start", "group", "i", "a")
    rows = rows.repartition(2 * groups, *group)
    found = rows.groupBy(*group).applyInArrow(_in_groups, "word string, near long, best_n long, best string")
    near = found.groupBy("word").agg(
        F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("fewer"), "best")).alias("best")
    )
    out = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(-F.col("best.fewer") >= ratio * F.col("n"), F.struct("best.best", (-F.col("best.fewer")).alias("n"))).alias("f"),
    )
    out = out.select("word", "n", "n_near", F.col("f.best").alias("form"), F.col("f.n").alias("form_n"))
    out = stage.keep(out, "forms")
    ends = out.filter("form is not null").select("word", F.col("form").alias("root"))
    most = words.agg(F.max("n")).first()[0] or 1
    hops = math.log(most) / math.log(ratio)
    for k in range(max(0, math.ceil(math.log2(max(1, hops))))):
        up = ends.select(F.col("word").alias("root"), F.col("root").alias("above"))
        ends = ends.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"))
        ends = stage.keep(ends, f"ends-{k}")
    out = out.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
