"""Words of whole batches as numpy arrays: bounds and 64-bit hashes without a Python object for each word."""

from __future__ import annotations

import numpy as np

#: An odd multiplier has an inverse modulo 2^64, so that any span's polynomial is a difference of running sums.
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, modulo 2^64."""
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        _powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, _BASE, np.uint64))))
        _inverse = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, pow(_BASE, -1, 1 << 64), np.uint64))))
    return _powers[:n], _inverse[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all 64."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    return h


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each span."""
    p, inv = powers(len(values) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((values.astype(np.uint64) + np.uint64(1)) * p[: len(values)])))
    return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def word_spans(raw: np.ndarray, is_word: np.ndarray, offsets: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes within each row, cut before marked bytes, and the index of the first word of each row (and of the end)."""
    inside = is_word[raw]
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < len(raw)]
    begins[edges] = inside[edges]
    last = edges[edges > 0] - 1
    stops[last] = inside[last]
    if cuts is not None:
        begins |= inside & cuts
        stops[:-1] |= inside[:-1] & cuts[1:]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)
