"""Hashed word n-grams of whole texts, computed on arrays."""

from __future__ import annotations

import numpy as np

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Letters, also bytes of letters beyond ASCII, digits; other characters stand for themselves.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = 97, 65, 48, 97
_powers: list[np.ndarray] = [np.ones((1, 1), np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r^k and r^-k for k up to ``n``, modulo 2^64."""
    if _powers[0].shape[1] <= n:
        size = max(1 << 16, 1 << (n + 1).bit_length())
        up = np.concatenate(([np.uint64(1)], np.full(size - 1, _R))).cumprod(dtype=np.uint64)
        down = np.concatenate(([np.uint64(1)], np.full(size - 1, _R_INV))).cumprod(dtype=np.uint64)
        _powers[0] = np.stack([up, down])
    return _powers[0][0], _powers[0][1]


def _hashes(chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of each slice."""
    up, down = _power(len(chars))
    sums = np.concatenate(([np.uint64(0)], np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * up[: len(chars)], dtype=np.uint64)))
    return (sums[ends] - sums[starts]) * down[starts]


def hashed_ngrams(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers below 2^bits, and L2-normalised root counts, of a text's word n-grams.

    They are words and word pairs in lower case, and single, paired and triple word shapes (runs of
    letters, capitals and digits as one sign each), where a word that repeats the one before has a
    shape of its own. Bucket 0 is 1 for every text, null and empty ones included.
    """
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    inside = ~_SPACE[raw]
    turn = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    if not starts.size:
        return np.zeros(1, np.int64), np.ones(1)
    words = _hashes(_LOWER[raw], starts, ends)
    shape = _SHAPE[raw]
    keep = np.ones(len(raw), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[starts] = True
    place = np.concatenate(([0], np.cumsum(keep)))
    shapes = _hashes(shape[keep], place[starts], place[ends])
    shapes[1:][words[1:] == words[:-1]] ^= np.uint64(0x5555)
    grams = [words, words[:-1] * _R + words[1:], shapes ^ _MIX, shapes[:-1] * _MIX + shapes[1:], (shapes[:-2] * _MIX + shapes[1:-1]) * _R + shapes[2:]]
    salted = np.concatenate([(g + np.uint64(k)) * _MIX for k, g in enumerate(grams)])
    salted ^= salted >> np.uint64(29)
    where, counts = np.unique(((salted * _R) >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
    values = np.sqrt(counts.astype(np.float64))
    values /= np.linalg.norm(values)
    other = where > 0
    return np.concatenate(([0], where[other])), np.concatenate(([1.0], values[other]))
