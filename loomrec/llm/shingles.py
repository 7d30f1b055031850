"""Shingles of words as 64-bit hashes, for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on each other."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 19)
        _powers[:] = []
        for base in (_BASE, _BASE_INV):
            p = np.full(size, base)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, A-Z in lower case, and n + 1 offsets into them.

    Words are runs of bytes other than white space of ASCII.
    """
    folded = _FOLD[data]
    solid = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)  # whether a text begins here
    first[offsets] = True
    before = np.concatenate([[False], solid])
    start = np.flatnonzero(solid & (~before[:-1] | first[:-1]))
    end = np.flatnonzero(before[1:] & (~np.concatenate([solid[1:], [False]]) | first[1:])) + 1
    up, down = _tables(len(data))
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTES[folded] * up[: len(data)], dtype=_U)])
    hashes = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U))
    return hashes, np.searchsorted(start, offsets)


def shingle_hashes(words: np.ndarray, cuts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of width words and the number of the text of each; a shorter text, if not empty, is one shingle whole."""
    count = np.diff(cuts)
    full = np.maximum(count - width + 1, 0)
    owner = np.repeat(np.arange(len(count)), full)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full) + np.repeat(cuts[:-1], full)
    out = np.zeros(len(at), _U)
    for k in range(width):
        out = out * _BASE + words[at + k]
    brief = np.flatnonzero((count > 0) & (count < width))
    if len(brief):
        whole = np.full(len(brief), _U(width))
        for k in range(width - 1):
            here = count[brief] > k
            whole[here] = whole[here] * _BASE_INV + words[cuts[brief[here]] + k]
        out, owner = np.concatenate([out, whole + count[brief].astype(_U)]), np.concatenate([owner, brief])
    return mix(out), owner


def distinct_shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in rising order, and n + 1 offsets into them."""
    words, cuts = word_hashes(data, offsets)
    hashes, owner = shingle_hashes(words, cuts, width)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(offsets)))


def blocks(offsets: np.ndarray, size: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about size bytes; a longer text is a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, b
        a = b
