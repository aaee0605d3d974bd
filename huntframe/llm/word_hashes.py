"""64-bit hashes of the words of many texts at once, with numpy, on the slices of an Arrow column."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Bytes of words between blanks, and of words of letters, digits and all beyond ASCII (after folding).
BETWEEN_BLANKS = np.ones(256, bool)
BETWEEN_BLANKS[[32, *range(9, 14)]] = False
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """The first powers of a base modulo 2^64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, U64)
        known[0] = 1
        known = _powers[base] = np.multiply.accumulate(known)
    return known[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def words_of(data: np.ndarray, starts: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the row it stands in. ``starts``: where rows start in the bytes, and the end."""
    data = FOLD[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = word_bytes[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2] | edge[1:-1]
    last = inside[:-1] & (~inside[1:] | edge[1:])
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(len(data)), out=sums[1:])
    hashes = mixed((sums[end] - sums[begin]) * powers(len(data) + 1, _INVERSE)[begin])
    return hashes, np.searchsorted(starts, begin, "right") - 1


def grams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``n`` words from each word on, and whether they all stand in its row; the last ``n - 1`` are left out."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, U64), np.zeros(0, bool)
    out = np.full(size, n, U64)
    for i in range(n):
        out = out * U64(0xD6E8FEB86659FD93) + hashes[i : i + size]
    return mixed(out), rows[:size] == rows[n - 1 : n - 1 + size]
