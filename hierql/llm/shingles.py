"""Hashed words and word shingles of a batch of texts, computed on whole arrays."""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np

from .common import mix64

WIDTH = 5
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_FACTORS = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_POWERS: dict[str, np.ndarray] = {}


@cache
def _word_bytes() -> np.ndarray:
    """Letters, digits, the underscore and every byte of a non-ASCII character."""
    return np.array([chr(i).isalnum() or i == 95 if i < 128 else True for i in range(256)])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _POWERS[name] = np.cumprod(factors)
    return _POWERS["up"], _POWERS["down"]


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words of all texts, and each text's first word (n + 1 bounds).

    A word is a run of letters, digits, underscores and non-ASCII characters.
    """
    coded = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b" ".join([*coded, b""]) or b" ", np.uint8)
    inside = _word_bytes()[raw]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(raw) + 1)
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=prefix[1:])
    hashes = mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    offsets = np.concatenate([[0], np.cumsum([len(c) + 1 for c in coded])]) if coded else np.zeros(1, np.int64)
    return hashes, np.searchsorted(starts, offsets)


def shingles(texts: list[str | None], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words, and each text's bounds (n + 1).

    A text of fewer words has one shingle of all its words; one without a word has none.
    """
    hashes, bounds = words(texts)
    counts = np.diff(bounds)
    n = len(hashes)
    combined = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width):
        combined += hashes[k : n - width + 1 + k] * _FACTORS[k % 5] + np.uint64(k // 5)
    combined = mix64(combined)
    out_counts = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate([[0], np.cumsum(out_counts)])
    full = counts >= width
    out = np.empty(out_bounds[-1], np.uint64)
    if full.any():
        spread = np.repeat(bounds[:-1][full] - out_bounds[:-1][full], out_counts[full])
        at = np.repeat(full, out_counts)
        where = np.flatnonzero(at)
        out[where] = combined[where + spread]
    for i in np.flatnonzero((counts > 0) & ~full):
        own = hashes[bounds[i] : bounds[i + 1]]
        out[out_bounds[i]] = mix64(np.array([int((own * _FACTORS[: len(own)]).sum()) & (2**64 - 1)], np.uint64) + np.uint64(7 + len(own)))[0]
    return out, out_bounds


def set_digest(sorted_unique: np.ndarray) -> bytes:
    return hashlib.blake2b(sorted_unique.tobytes(), digest_size=16).digest()


@cache
def multipliers(count: int) -> np.ndarray:
    return mix64(np.arange(1, count + 1, dtype=np.uint64) * _BASE) | np.uint64(1)


def min_hashes(values: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """(n, count) uint32 MinHash values; rows of texts without shingles are zero."""
    out = np.zeros((len(bounds) - 1, count), np.uint32)
    filled = np.flatnonzero(np.diff(bounds) > 0)
    if not len(filled):
        return out
    starts = bounds[filled]
    scratch = np.empty_like(values)
    for k, a in enumerate(multipliers(count)):
        np.multiply(values, a, out=scratch)
        out[filled, k] = np.minimum.reduceat(scratch, starts) >> np.uint64(32)
    return out
