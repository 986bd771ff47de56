"""Language identification by cross-parsing.

Per language a sample of labelled text is turned into a suffix automaton. A text is
parsed against each: take the longest stretch that occurs in the sample, start anew
behind it. A language costs ``phrases * log2(sample length) / characters``; the one
with the lowest cost wins (of equal costs the first by code point).

Letters are lower-cased; all that is not a letter is one blank. The automata become
one table over (state, letter), with the restart of a phrase folded in, and texts are
parsed side by side: each step moves one letter along in all of them. So that long
texts keep step they are parsed in stretches of ``STRETCH`` letters, which ends a
phrase early once per stretch, for all languages alike. Every letter is parsed.

The sample is the only bounded part: ``SAMPLE_CHARS`` per language, from whole
documents drawn by a hash of their text. What leaves the executors is about twice that.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import ship, tidied

SAMPLE_CHARS = 20_000
LETTERS = 62
STRETCH = 1024
BATCH_CHARS = 500_000
UNKNOWN = "und"

Sample = tuple[tuple[str, str], ...]


def draw_sample(df: DataFrame, lang: str = "lang", text: str = "text", chars: int = SAMPLE_CHARS) -> Sample:
    """(language, text) pairs, sorted; rows without label, text or letters are left out.

    Documents longer than a quarter of the sample are drawn only where all shorter ones
    of the language do not fill it, so that no single one makes up a language that has others.
    """
    rows = df.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    rows = rows.withColumn("n", F.length("text")).withColumn("draw", F.xxhash64("text"))
    # Copies count once: they share a draw and are drawn together. One small row per
    # language comes to the driver.
    short = F.col("n") <= chars // 4
    alone = rows.select("lang", "draw", "n").distinct()
    size = F.sum(F.when(short, F.col("n"))).alias("short")
    sizes = {r.lang: r.short or 0 for r in alone.groupBy("lang").agg(size).collect()}
    found: dict[str, set[tuple[int, str]]] = {lang: set() for lang in sizes}

    def draw(own: dict[str, Column]) -> None:
        drawn = functools.reduce(lambda a, b: a | b, ((F.col("lang") == lang) & c for lang, c in own.items()))
        for r in rows.filter(drawn).select("lang", "draw", "text").distinct().collect():
            found[r.lang].add((r.draw, r.text))

    def lacking(langs: Iterable[str]) -> list[str]:
        return [lang for lang in langs if sum(len(t) for _, t in found[lang]) < chars]

    # Per language the part of the hash range to draw, twice what the sample needs, and
    # more of it as long as the sample is not full.
    share = {lang: min(1.0, 2.0 * chars / n) for lang, n in sizes.items() if n}
    todo = list(share)
    while todo:
        draw({lang: short & (F.col("draw") <= _cut(share[lang])) for lang in todo})
        todo = [lang for lang in lacking(todo) if share[lang] < 1]
        share.update({lang: min(1.0, 4 * share[lang]) for lang in todo})
    texts = {lang: _joined(found[lang], chars) for lang in sizes}
    # Where short documents do not fill it, longer ones follow, the shortest first.
    last: dict[str, tuple[int, int]] = dict.fromkeys(lacking(sizes), (chars // 4, 2**63 - 1))
    while last:
        later = F.lit(False)
        for lang, (n, k) in last.items():
            later |= (F.col("lang") == lang) & ((F.col("n") > n) | ((F.col("n") == n) & (F.col("draw") > k)))
        least = alone.filter(later).groupBy("lang").agg(F.min(F.struct("n", "draw")).alias("least")).collect()
        last = {r.lang: (r.least.n, r.least.draw) for r in least}
        if last:
            for lang in last:
                found[lang].clear()
            draw({lang: (F.col("n") == n) & (F.col("draw") == k) for lang, (n, k) in last.items()})
            for lang in last:
                texts[lang] = (texts[lang] + " " + _joined(found[lang], chars))[: chars + 1]
            last = {lang: at for lang, at in last.items() if len(texts[lang]) <= chars}
    return tuple(sorted(texts.items()))


def _cut(share: float) -> int:
    return 2**63 - 1 if share >= 1 else int(share * 2.0**64 - 2.0**63)


def _joined(found: set[tuple[int, str]], chars: int) -> str:
    out = ""
    for _, text in sorted(found):
        if len(out) >= chars:
            break
        out = (out + " " + text)[: chars + 1]
    return out


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts all substrings; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, depth, last = [-1], [0], 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        depth.append(depth[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if depth[p] + 1 == depth[q]:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                depth.append(depth[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


@functools.lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Per code point: the lower-cased letter, or 0 for what is not a letter."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L":
            table[c] = ord(ch.lower()[0])
    return table


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


class CrossParser:
    """Samples as one transition table; symbol 0 is a blank, 1 any other letter."""

    def __init__(self, sample: Sample) -> None:
        letters = letter_table()
        texts = [letters[codes(t)] for _, t in sample]
        seen = np.unique(np.concatenate(texts), return_counts=True) if texts else (np.zeros(0, int),) * 2
        order = [int(c) for c in seen[0][np.lexsort((seen[0], -seen[1]))] if c][:LETTERS]
        of = np.ones(sys.maxunicode + 1, np.uint8)
        of[0] = 0
        of[order] = np.arange(2, 2 + len(order))
        self.symbol = of[letters]
        self.languages = [lang for lang, _ in sample]
        tables, self.start, self.bits = [], [], []
        for t in texts:
            symbols = of[t]
            symbols = symbols[np.append(True, (symbols[1:] != 0) | (symbols[:-1] != 0))]
            moves = suffix_automaton(symbols.tolist())
            first = sum(map(len, tables))
            self.start.append(first)
            self.bits.append(np.log2(max(2, len(symbols))))
            # Entry: twice the place of the next state's row, plus 1 where a phrase begins.
            # A letter that the sample lacks is a phrase of its own.
            again = np.full(64, first * 128 + 1, np.int32)
            for c, to in moves[0].items():
                again[c] = (first + to) * 128 + 1
            table = np.tile(again, (len(moves), 1))
            for state, row in enumerate(moves[1:], 1):
                for c, to in row.items():
                    table[state, c] = (first + to) * 128
            tables.append(table)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(64, np.int32)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases per language and text; letters and blanks, and letters, per text."""
        sizes = np.array([len(t) for t in texts])
        symbols = self.symbol[codes("\n".join([*texts, ""]))]
        keep = symbols != 0
        is_letter = np.append(0, np.cumsum(keep))
        keep[1:] |= keep[:-1]  # one blank after each letter run
        place = np.append(0, np.cumsum(keep))
        symbols = symbols[keep]
        ends = np.cumsum(sizes + 1) - 1
        begin, end = place[ends - sizes], place[ends]
        n_letters = is_letter[ends] - is_letter[ends - sizes]
        size = end - begin
        lanes = -(-size // STRETCH)
        owner = np.repeat(np.arange(len(texts)), lanes)
        offset = (np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * STRETCH
        length = np.minimum(STRETCH, size[owner] - offset)
        by_length = np.argsort(-length, kind="stable")
        owner, length, at = owner[by_length], length[by_length], (begin[owner] + offset)[by_length]
        counts = np.zeros((len(self.languages), len(owner)), np.int32)
        state = np.repeat(np.array(self.start, np.int32)[:, None] * 128, len(owner), 1)
        active = len(owner) - np.searchsorted(length[::-1], np.arange(STRETCH), side="right")
        for t in range(int(length[0]) if len(length) else 0):
            k = active[t]
            now = state[:, :k] >> 1
            now += symbols[at[:k] + t]
            now = self.table.take(now, mode="clip")
            counts[:, :k] += now & 1
            state[:, :k] = now
        total = np.zeros((len(self.languages), len(texts)), np.int64)
        for k in range(len(self.languages)):
            total[k] = np.bincount(owner, counts[k], len(texts))
        return total, size, n_letters

    def identify(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total, size, n_letters = self.phrases(texts)
        cost = total * np.array(self.bits)[:, None] / np.maximum(size, 1)
        best = cost.argmin(0)
        least = cost.min(0)
        score = 1.0 / np.exp2(least - cost).sum(0)
        known = n_letters > 0
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, known)]
        return names, np.where(known, score, 0.0)


@functools.lru_cache(maxsize=2)
def parser(sample: Sample) -> CrossParser:
    return CrossParser(sample)


def identify(df: DataFrame, sample: Sample, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` from the whole text; nothing else is read.

    The score is the winner's share of ``2 ** -cost`` over all languages, 0 to 1.
    A null text, one without a letter, or an empty sample gives ``und`` and 0.
    Columns of these names are replaced; every row is kept.
    """
    ship(df.sparkSession)
    out = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("lang string, score double")
    @tidied(parser)
    def named(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parse = parser(sample)
        for batch in batches:
            names, scores, some, held = [], [], [], 0
            for t in batch:
                some.append(t.as_py() or "")
                held += len(some[-1])
                if held >= BATCH_CHARS:
                    a, b = parse.identify(some)
                    names += a
                    scores.append(b)
                    some, held = [], 0
            a, b = parse.identify(some)
            names += a
            scores.append(b)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores))], fields=list(out))

    both = df.withColumn("_named", named(F.col(text)))
    return both.withColumns({"lang_pred": F.col("_named.lang"), "score": F.col("_named.score")}).drop("_named")
