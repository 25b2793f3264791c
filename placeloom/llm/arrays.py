"""Numpy kernels on Arrow text columns: word splitting, rolling hashes, window minima."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
#: Words by white space: every byte but 0x20 and 0x09-0x0D.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words of letters and digits: ASCII letters, digits and all bytes of other characters.
ALNUM = np.ones(256, bool)
ALNUM[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
AS_IS = np.arange(256, dtype=np.uint8)
LOWER = AS_IS.copy()
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))
_powers: dict = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i below n."""
    if not _powers or len(_powers["up"]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        for name, p in (("up", _P), ("down", _PINV)):
            x = np.ones(size, np.uint64)
            have = 1
            while have < size:
                x[have : 2 * have] = x[:have] * np.uint64(pow(p, have, 1 << 64))
                have *= 2
            _powers[name] = x
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """c with hash of values[i:j] = (c[j] - c[i]) * P**-i, before mixing."""
    c = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=c[1:])
    return c


def range_hashes(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((c[ends] - c[starts]) * powers(len(c))[1][starts])


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values (also those that cross documents)."""
    return grams_of(prefix_hashes(values), k) if len(values) >= k else np.zeros(0, np.uint64)


def grams_of(c: np.ndarray, k: int) -> np.ndarray:
    """``gram_hashes`` of the values with the prefix hashes c."""
    return mix((c[k:] - c[:-k]) * powers(len(c))[1][: len(c) - k]) if len(c) > k else np.zeros(0, np.uint64)


def sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over each w consecutive values."""
    if len(x) < w:
        return x[:0]
    have, y = 1, x
    while 2 * have <= w:
        y = op(y[:-have], y[have:])
        have *= 2
    if have < w:
        y = op(y[: len(x) - w + 1], y[w - have : w - have + len(x) - w + 1])
    return y


def release() -> None:
    """Gives freed memory back, as workers idle between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_chunks(column: pa.Array, most: int = 2 << 20):
    """(first row, byte buffer, offsets) of runs of whole rows of about ``most`` bytes; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def split_words(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: np.ndarray):
    """(starts, ends, words before each row, hash per word) of the runs of word bytes in each row."""
    inside = is_word[buf]
    before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    rows = offsets[offsets < len(buf)]
    before[rows] = False
    after[rows[rows > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    c = prefix_hashes((BYTE_VALUE if fold is AS_IS else BYTE_VALUE[fold])[buf])
    return starts, ends, np.searchsorted(starts, offsets), range_hashes(c, starts, ends)


def within_rows(n: int, counts_before: np.ndarray, k: int) -> np.ndarray:
    """Which of the n - k + 1 windows of k items lie in one row; counts_before: items before each row, and all."""
    row = np.repeat(np.arange(len(counts_before) - 1), np.diff(counts_before))
    return row[: max(0, n - k + 1)] == row[k - 1 :] if n >= k else np.zeros(0, bool)
