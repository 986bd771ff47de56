"""Hashed word n-grams of many texts at once.

A word's hash is a polynomial over its bytes, taken as the difference of two running
sums, so a block of texts needs no Python object per word.
"""

from __future__ import annotations

import functools

import numpy as np

_RNG = np.random.default_rng(20)
BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@functools.lru_cache(maxsize=3)
def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of ``base`` modulo 2**64, and of its inverse."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def power_size(n: int) -> int:
    """A table size that few calls differ in."""
    return 1 << max(16, int(n).bit_length())


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words in order, and how many each text has."""
    flat = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    white = WHITE[flat]
    begin = np.flatnonzero(~white & np.append(True, white[:-1])) if len(flat) else np.zeros(0, int)
    end = np.flatnonzero(white & np.append(False, ~white[:-1])) if len(flat) else begin
    up, down = (p[: len(flat) + 1] for p in powers(power_size(len(flat))))
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(BYTE[LOWER[flat]] * up[:-1], out=sums[1:])
    hashes = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    borders = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(begin, borders), prepend=0)


CHUNK_BYTES = 500_000


def shingle_sets(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """Per text its sorted distinct hashed n-grams.

    A text of fewer than ``n`` words has its whole sequence as the only one; null and
    texts without words have none. Texts are hashed some at a time, each one whole.
    """
    out, some, held = [], [], 0
    for text in texts:
        if some and held + len(text or b"") > CHUNK_BYTES:
            out += _sets(some, n)
            some, held = [], 0
        some.append(text)
        held += len(text or b"")
    return out + _sets(some, n) if some else out


def _sets(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    words, counts = word_hashes([t or b"" for t in texts])
    out = []
    ends = np.cumsum(counts)
    grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        grams = mix(grams * np.uint64(3) + words[k : len(words) - n + 1 + k])
    for count, end in zip(counts.tolist(), ends.tolist()):
        if count >= n:
            out.append(np.unique(grams[end - count : end - n + 1]))
            continue
        whole = np.full(1 if count else 0, count, np.uint64)
        for w in words[end - count : end]:
            whole = mix(whole * np.uint64(5) + w)
        out.append(whole)
    return out
