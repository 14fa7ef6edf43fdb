"""Words and word shingles of many texts at once, as 64-bit hashes in numpy arrays.

A text's words are the runs of letters, digits and underscores of its lower-cased form. Hashes of all words come from one
cumulative sum: with powers of an odd number modulo 2**64, the hash of a span is a difference of sums times an inverse power.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

CHUNK_CHARS = 400_000  # texts are taken together up to so many characters; a longer text stands alone

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD1342543DE82EF95)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def word_table() -> np.ndarray:
    return np.fromiter((c.isalnum() or c == "_" for c in map(chr, range(0x110000))), bool, 0x110000)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers; those of a usual chunk are kept, longer ones made anew and let go."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    made = []
    for base in (_BASE, _BASE_INVERSE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        made.append(np.cumprod(p))
    if n <= 2 * CHUNK_CHARS:
        _powers[:] = made
    return made[0], made[1]


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about CHUNK_CHARS characters."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_CHARS:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, a zero after each, and where each text begins (one entry more than texts)."""
    cp = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)), out=at[1:])
    return cp, at


def _spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last character of each word, where the texts begin, and the sums and inverse powers that hash any span."""
    cp, at = code_points([t.lower() for t in texts])
    cp, at = (cp, at) if len(cp) == at[-1] else code_points(texts)
    edge = np.flatnonzero(np.diff(word_table()[cp].view(np.int8), prepend=0))
    up, down = powers(len(cp))
    total = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(cp.astype(np.uint64) * up, out=total[1:])
    return edge[0::2], edge[1::2], at, total, down


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the index of each text's first word (one entry more than texts)."""
    begin, end, at, total, down = _spans(texts)
    return mix((total[end] - total[begin]) * down[begin]), np.searchsorted(begin, at)


def word_and_prefix_hashes(texts: list[str], lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and of the proper prefixes of the given lengths, and the text of each. Hashes of words are even, of prefixes odd."""
    begin, end, at, total, down = _spans(texts)
    text = np.searchsorted(at, begin, side="right") - 1
    h, of = [mix((total[end] - total[begin]) * down[begin]) & ~np.uint64(1)], [text]
    for k in lengths:
        long = end - begin > k
        b = begin[long]
        h.append(mix(((total[b + k] - total[b]) * down[b]) ^ _STEP) | np.uint64(1))
        of.append(text[long])
    return np.concatenate(h), np.concatenate(of)


def shingle_hashes(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of k words, and the index of the text of each. A text of fewer words, but not none, has one."""
    words, at = word_hashes(texts)
    n = np.diff(at)
    count = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    text = np.repeat(np.arange(len(texts)), count)
    first = at[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    last = at[1:][text] - 1
    out = np.zeros(len(text), np.uint64)
    for j in range(k):
        i = first + j
        out = out * _STEP + np.where(i <= last, words[np.minimum(i, last)], np.uint64(j + 1))
    return mix(out), text


def counted(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) pairs in that order, with their counts."""
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    return h[at], t[at], np.diff(np.append(at, len(h)))
