"""Vectorised helpers over the UTF-8 buffers of Arrow string columns.

Word boundaries, word hashes and word n-gram hashes of a whole batch are computed on
the byte buffer at once, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words that end at white space: all but 0x20 and 0x09-0x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False

#: Bytes of words made of digits, letters and everything beyond ASCII (after LOWER).
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null row is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.dtype(np.int64 if pa.types.is_large_string(column.type) else np.int32)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, width, len(column) + 1, column.offset * width.itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Runs of whole rows of about ``limit`` bytes: (first row, end row, bytes, offsets)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def tokens(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside`` bytes, none across rows, and each row's first run."""
    if not inside.size:
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    before, after = np.zeros(inside.size, bool), np.zeros(inside.size, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    firsts, lasts = offsets[:-1], offsets[1:]
    before[firsts[firsts < inside.size]] = False
    after[lasts[lasts > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, list[np.ndarray]] = {}


def _power_tables(n: int, seed: int = 0) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse; every seed has a base of its own."""
    if len(_powers.get(seed, [()])[0]) < n:
        size, tables = max(n, CHUNK_BYTES + 1), []
        for base in (_BASE + 2 * seed, pow(_BASE + 2 * seed, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        _powers[seed] = tables
    return _powers[seed]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values, so that all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def token_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges, equal for equal bytes in any batch (prefix sums of a polynomial)."""
    power, inverse = _power_tables(len(data) + 1, seed)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words that begin at each of the first ``len(words) - k + 1`` words."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[j:j + n]
    return mix(out + np.uint64(k))


def binary_array(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())
