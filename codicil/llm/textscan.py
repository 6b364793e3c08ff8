"""Vectorised word segmentation and hashing of UTF-8 text.

A batch of texts is one byte array with row offsets. Words are maximal runs of
bytes outside a separator set that don't cross a row's end. A word's hash mixes
each eight bytes together with their place in the word, which no two words undo
alike, and adds them up; runs of k words are polynomials over word hashes.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All of ASCII but its letters and digits.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

U = np.uint64
#: Pieces of eight bytes that are hashed at once.
_PIECES = 1 << 19
_rng = np.random.Generator(np.random.PCG64(20240607))
_M64 = (1 << 64) - 1
_PLACE, _LENGTH, _STEP = (int(x) * 2 + 1 for x in _rng.integers(1 << 62, 1 << 63, 3))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the n+1 offsets of each row's words among them."""
    if not len(data):
        z = np.empty(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of each word; with `lower`, of the word with A-Z in lower case."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = LOWER[data] if lower else data
    eight = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    sizes = ends - starts
    # A word of no bytes has one piece too, of which nothing is left.
    pieces = np.maximum((sizes + 7) >> 3, 1)
    before = np.concatenate([[0], np.cumsum(pieces)])
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(before, before[i] + _PIECES, "right")) - 1)
        n, first = pieces[i:j], before[i:j] - before[i]
        place = np.arange(before[j] - before[i]) - np.repeat(first, n)
        left = np.repeat(sizes[i:j], n) - 8 * place
        value = eight[np.repeat(starts[i:j], n) + 8 * place]
        cut = np.clip(8 - left, 0, 8).astype(np.uint64) * U(8)
        value = np.where(cut < U(64), value & (U(_M64) >> np.minimum(cut, U(63))), U(0))
        value = mix(value ^ mix(place.astype(np.uint64) * U(_PLACE)))
        out[i:j] = mix(np.add.reduceat(value, first) + sizes[i:j].astype(np.uint64) * U(_LENGTH))
        i = j
    return out


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes: n-k+1 values, by doubling."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total, have, block, size, at = None, 0, hashes, 1, 0
    left = k
    while left:
        if left & 1:
            part = block[at : at + n]
            total = part.copy() if total is None else total * U(pow(_STEP, size, 1 << 64)) + part
            at += size
        left >>= 1
        if left:
            block = block[: len(block) - size] * U(pow(_STEP, size, 1 << 64)) + block[size:]
            size *= 2
    return mix(total)


def run_starts(bounds: np.ndarray, k: int) -> np.ndarray:
    """Indices of the words at which a run of k words of one row begins. bounds: n+1 word offsets."""
    counts = np.maximum(np.diff(bounds) - k + 1, 0)
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(bounds[:-1] - before, counts)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
