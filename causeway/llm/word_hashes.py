"""Hashes of words and of runs of words, many texts at a time with numpy.

A byte string's hash is a polynomial in an odd base modulo 2^64; differences of prefix sums, divided
by a power of the base, give the hash of any stretch. Words are hashed over their bytes, runs over
their words' mixed hashes.
"""

from __future__ import annotations

import numpy as np

_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 20
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = {k: np.ones(1, np.uint64) for k in (_BASE, _INVERSE)}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        steps = np.full(max(n, 2 * _BLOCK), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps)
    return _powers[base][:n]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    return _power(_BASE, n), _power(_INVERSE, n)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stretches(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of the values from each start to each end."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(_BASE, len(values)), out=sums[1:])
    return (sums[ends] - sums[starts]) * _power(_INVERSE, len(values) + 1)[starts]


def word_hashes(texts: list[bytes], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts in order, and the number of words of each text."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    block: list[bytes] = []
    owners: list[int] = []

    def flush() -> None:
        b = np.frombuffer(b" ".join([*block, b""]), np.uint8)
        space = _IS_SPACE[b]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate([[0], edge])
        starts, ends = edge[0::2], edge[1::2]
        raw = stretches(b.astype(np.uint64) + np.uint64(1), starts, ends)
        hashes.append(mix(raw + np.uint64((seed * 2 + 1) * 0x9E3779B97F4A7C15 % 2**64) * (ends - starts).astype(np.uint64)))
        bounds = np.cumsum([len(x) + 1 for x in block])
        np.add.at(counts, owners, np.diff(np.searchsorted(starts, bounds), prepend=0))

    held = 0
    for k, t in enumerate(texts):
        at = 0
        while at < len(t):
            end = min(at + _BLOCK, len(t))
            while end < len(t) and not _IS_SPACE[t[end]]:
                end += 1
            block.append(t[at:end])
            owners.append(k)
            held += end - at
            at = end
            if held >= _BLOCK:
                flush()
                block, owners, held = [], [], 0
    if block:
        flush()
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """For each place the hash of the run of so many words from there; the last length - 1 places are left out."""
    n = max(0, len(words) - length + 1)
    out = np.empty(n, np.uint64)
    for at in range(0, n, _BLOCK):
        to = min(n, at + _BLOCK)
        starts = np.arange(to - at)
        out[at:to] = stretches(words[at : to + length - 1], starts, starts + length)
    return mix(out)
