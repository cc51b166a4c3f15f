"""Vectorised words and word hashes over whole Arrow columns, in numpy.

A word is a maximal run of bytes other than space and 9 to 13; UTF-8 never has these inside a character."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE, _SEED = 0x9E3779B97F4A7C15, 20240229
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(_SEED).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _power(way: str, n: int) -> np.ndarray:
    if len(_powers[way]) < n:
        n = 1 << (n - 1).bit_length()
        steps = np.full(n, _BASE if way == "up" else _INVERSE, U)
        steps[0] = 1
        _powers[way] = np.cumprod(steps, dtype=U)
    return _powers[way][:n]


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and row of each word."""
    n = len(data)
    word = ~_BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[:1], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1:], after[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words' bytes: a polynomial over random byte values, by prefix sums."""
    n = len(data)
    sums = np.zeros(n + 1, U)
    np.cumsum(_BYTES[data] * _power("up", n + 1)[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("down", n + 1)[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive word hashes (len - k + 1 of them; rows are not looked at)."""
    n = len(h)
    if n < k:
        return np.zeros(0, U)
    sums = np.zeros(n + 1, U)
    np.cumsum(h * _power("up", n + 1)[:n], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * _power("down", n + 1)[: n - k + 1])


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each k consecutive values."""
    if len(x) < k:
        return x[:0]
    w, out = 1, x
    while w * 2 <= k:
        out = np.minimum(out[:-w], out[w:])
        w *= 2
    return np.minimum(out[: len(x) - k + 1], out[k - w : k - w + len(x) - k + 1])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 3) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each row, A-Z lower-cased; fewer words: their whole sequence as one; none: empty."""
    data = lower(data)
    starts, ends, rows = split_words(data, offsets)
    h = hash_words(data, starts, ends)
    s = window_hashes(h, k)
    first = np.searchsorted(rows, np.arange(len(offsets)))
    out = []
    for i in range(len(offsets) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            x = np.sort(s[a : b - k + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif b > a:
            out.append(mix(window_hashes(h[a:b], b - a) + U(b - a) * U(31)))
        else:
            out.append(np.zeros(0, U))
    return out
