"""Whole columns of text as byte arrays: words and their 64-bit hashes without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer single text is handled alone.
SLAB = 1 << 20

_MULT = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_P = 0xD6E8FEB86659FD93
_P_INV = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of uint64 values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


#: A 64-bit value for each byte.
BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_MULT))

#: A-Z to a-z; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words between white space: all but space and 09-0D.
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False

#: Bytes of words of digits, letters and everything beyond ASCII.
WORDISH = np.zeros(256, dtype=bool)
WORDISH[48:58] = WORDISH[65:91] = WORDISH[97:123] = WORDISH[128:] = True

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse, modulo 2**64; kept for the process."""
    if len(_powers[0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        for k, base in enumerate((_P, _P_INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def slabs(column: pa.Array | pa.ChunkedArray, limit: int = SLAB) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, n + 1 offsets) for runs of rows with about ``limit`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(buf: np.ndarray, offs: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the maximal runs of ``kept`` bytes within each text; n + 1 word offsets of the texts."""
    inside = kept[buf]
    before = np.empty(len(buf) + 1, bool)
    before[0] = False
    before[1:] = inside
    before[offs] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.empty(len(buf) + 1, bool)
    after[-1] = False
    after[:-1] = inside
    after[offs] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the A-Z-folded bytes of each [start, end)."""
    n = len(buf)
    up, down = powers(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(BYTE[LOWER[buf]] * up[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(_MULT))


def word_hashes(buf: np.ndarray, offs: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the n + 1 word offsets of the texts."""
    starts, ends, at = words(buf, offs, kept)
    return hashes(buf, starts, ends), at


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
