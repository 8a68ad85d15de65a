"""Sets of word shingles as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np

from .shared import folded

#: Bytes hashed at once: a block's arrays take about forty times as much.
BLOCK = 1 << 20
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA24BAED4963EE407, 0x9FB21C651E98DF25)
_PLACES = 1 << 16
_RNG = np.random.default_rng(20_240_602)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTE[32] = 0  # blanks add nothing
_PLACE = _RNG.integers(0, 1 << 63, _PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each stretch between blanks of ``data``, which are bytes.

    A word's hash is the sum of its bytes' numbers times their places' numbers, mixed. Sums go on from block to
    block, so no table of words is kept and a word may be of any length.
    """
    sums, firsts, begin, blank = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0, True
    for a in range(0, len(data), BLOCK):
        x = data[a : a + BLOCK]
        inside = x != 32
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[0] &= blank
        blank = not inside[-1]
        at = np.flatnonzero(first)
        rest = not len(at) or at[0] > 0  # what stands before the first word belongs to the last one
        cuts = np.concatenate([[0], at]) if rest else at
        starts = at + a
        place = np.arange(a, a + len(x)) - np.repeat(np.concatenate([[begin], starts]) if rest else starts, np.diff(cuts, append=len(x)))
        v = _BYTE[x] * _PLACE[place & (_PLACES - 1)]
        if place.max() >= _PLACES:
            v *= (place >> 16).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        s = np.add.reduceat(v, cuts)
        if rest:
            if len(sums[-1]):
                sums[-1][-1:] += s[:1]
            s = s[1:]
        if len(starts):
            sums.append(s)
            firsts.append(starts)
            begin = int(starts[-1])
    return _finish(np.concatenate(sums)), np.concatenate(firsts)


def word_hashes(text: str) -> np.ndarray:
    return hashed_words(np.frombuffer(folded(text), np.uint8))[0]


def shingle_set(text: str, size: int) -> np.ndarray:
    """Distinct shingles of ``size`` words, sorted; fewer words are one shingle, none is the empty set."""
    h = word_hashes(text)
    k = min(size, len(h))
    if not k:
        return h
    n = len(h) - k + 1
    x = np.full(n, k, np.uint64)
    for i in range(k):
        x = _finish(x ^ (h[i : i + n] * np.uint64(_MIX[i % len(_MIX)])))
    return np.unique(x)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
