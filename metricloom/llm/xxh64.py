"""XXH64 of many byte spans at once, in vectors: each step of the algorithm runs over all spans that are long enough for it."""

from __future__ import annotations

import numpy as np

#: Fixed values of the algorithm: its five primes.
P1, P2, P3, P4, P5 = (
    np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)
#: Spans that are hashed at once, so that a step's vectors stay in the cache.
LOT = 1 << 14


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotated(acc + lane * P2, 31) * P1


def _hashed(eight: np.ndarray, four: np.ndarray, one: np.ndarray, at: np.ndarray, size: np.ndarray, seed: np.uint64) -> np.ndarray:
    h = np.full(len(at), seed + P5, np.uint64)
    at, left = at.copy(), size.copy()
    live = np.flatnonzero(left >= 32)
    if len(live):
        acc = [np.full(len(live), x, np.uint64) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
        which = np.arange(len(live))  # of the accumulators
        while len(which):
            p = at[live[which]]
            for k in range(4):
                acc[k][which] = _round(acc[k][which], eight[p + 8 * k])
            at[live[which]] += 32
            left[live[which]] -= 32
            which = which[left[live[which]] >= 32]
        merged = _rotated(acc[0], 1) + _rotated(acc[1], 7) + _rotated(acc[2], 12) + _rotated(acc[3], 18)
        zero = np.zeros(len(live), np.uint64)
        for a in acc:
            merged = (merged ^ _round(zero, a)) * P1 + P4
        h[live] = merged
    h += size.astype(np.uint64)
    for step, words, mix in (
        (8, eight, lambda x, v: _rotated(x ^ _round(np.zeros(len(x), np.uint64), v), 27) * P1 + P4),
        (4, four, lambda x, v: _rotated(x ^ (v.astype(np.uint64) * P1), 23) * P2 + P3),
        (1, one, lambda x, v: _rotated(x ^ (v.astype(np.uint64) * P5), 11) * P1),
    ):
        live = np.flatnonzero(left >= step)
        while len(live):
            h[live] = mix(h[live], words[at[live]])
            at[live] += step
            left[live] -= step
            live = live[left[live] >= step]
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """The hash of each span of the bytes ``data``."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    four = np.ndarray((len(data) + 1,), "<u4", padded, strides=(1,))
    out = np.empty(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(starts), LOT):
            some = slice(a, a + LOT)
            out[some] = _hashed(eight, four, padded, starts[some], ends[some] - starts[some], np.uint64(seed))
    return out
