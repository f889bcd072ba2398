"""Words of texts as numpy arrays: where they stand in the UTF-8 bytes, and 64-bit hashes of words and of runs of words."""

from __future__ import annotations

import numpy as np

U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mixed(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


BYTES = stream(1, 256)
POWERS = np.cumprod(np.full(1 << 16, 0xD1342543DE82EF95, U))
BLOCKS = stream(2, 1 << 12) | U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: White space [\x20\x09-\x0D] parts words.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Everything in ASCII but digits and small letters parts words.
ALNUM = np.ones(256, bool)
ALNUM[:128] = False
ALNUM[48:58] = ALNUM[97:123] = True


def lowered(text: str) -> np.ndarray:
    """The UTF-8 bytes of a text, A-Z as a-z."""
    return LOWER[np.frombuffer(text.encode(), np.uint8)]


def word_spans(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte after it; ``inside``: which bytes belong to words."""
    flags = np.zeros(len(data) + 2, np.int8)
    flags[1:-1] = inside[data]
    edges = np.flatnonzero(flags[1:] != flags[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(first):
        return np.zeros(0, U)
    length = end - first
    offset = np.cumsum(length) - length
    within = np.arange(int(length.sum())) - np.repeat(offset, length)
    terms = BYTES[data[within + np.repeat(first, length)]] * POWERS[within & 0xFFFF]
    if length.max() > 1 << 16:
        terms *= BLOCKS[(within >> 16) & 0xFFF]
    return mixed(np.add.reduceat(terms, offset) + length.astype(U))


ORDER = stream(3, 64) | U(1)


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of fewer words, one of the whole sequence."""
    n = len(words)
    if not n:
        return np.zeros(0, U)
    if n < size:
        return mixed((words * ORDER[:n]).sum(keepdims=True) + U(n))
    total = words[: n - size + 1] * ORDER[0]
    for k in range(1, size):
        total = total + words[k : n - size + 1 + k] * ORDER[k]
    return mixed(total + U(size))


def text_words(text: str | None, inside: np.ndarray = NOT_SPACE) -> np.ndarray:
    data = lowered(text or "")
    return word_hashes(data, *word_spans(data, inside))


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """The distinct shingles of a text, ascending."""
    return np.unique(shingles(text_words(text), size))
