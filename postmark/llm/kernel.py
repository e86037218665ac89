"""Vectorised text primitives shared by the corpus operators.

Everything works on the UTF-8 bytes of an Arrow string column: one byte buffer and
one offsets array for a whole slice of rows, so words and shingles are found and hashed
without a Python loop over rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time; bounds the size of the working arrays.
SLICE_BYTES = 2 << 20


def slices(batches, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches into runs of rows of about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes, dtype=np.int64)
        begin = 0
        while begin < n:
            before = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of len + 1) of a string array; null counts as empty."""
    array = pc.fill_null(array.cast(pa.large_string()), "")
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    _, off, data = array.buffers()
    offsets = np.frombuffer(off, np.int64)[array.offset : array.offset + len(array) + 1]
    if data is None or len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def table(members: str) -> np.ndarray:
    """A lookup table of bytes: True for the bytes named by kind."""
    t = np.zeros(256, bool)
    if members == "alnum":  # ASCII letters and digits, and every byte of a non-ASCII character
        t[48:58] = t[65:91] = t[97:123] = t[128:] = True
    elif members == "nonspace":  # all but the space and \t \n \v \f \r
        t[:] = True
        t[[32, *range(9, 14)]] = False
    else:
        raise ValueError(members)
    return t


ALNUM, NONSPACE = table("alnum"), table("nonspace")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_R, _RANDOM = 0x9E3779B97F4A7C15 | 1, np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _R, np.uint64)
    down = np.full(n, pow(_R, -1, 2**64), np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of member bytes; runs end at row borders."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = member[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    firsts = offsets[:-1]
    firsts = firsts[firsts < len(data)]
    opens = inside & ~before
    opens[firsts] = inside[firsts]
    closes = ~inside & before
    closes[firsts] = before[firsts]
    start = np.flatnonzero(opens)
    end = np.flatnonzero(closes)
    if inside[-1]:
        end = np.append(end, len(data))
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each byte range, A-Z lower-cased if asked for."""
    n = 1 << max(10, int(len(data)).bit_length())
    up, down = _powers(n)
    values = (_RANDOM[LOWER] if lower else _RANDOM)[data]
    values *= up[: len(data)]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return mix(h ^ (end - start).astype(np.uint64))


def shingles(h: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every k consecutive words of a row; a row of 1 to k - 1 words gives one for all its words."""
    counts = np.bincount(row, minlength=n_rows)
    first = np.concatenate(([0], np.cumsum(counts)))
    keys, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(h) >= k:
        total = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            total = mix(total + h[i : len(h) - k + 1 + i])
        whole = row[: len(total)] == row[k - 1 :]
        keys, rows = total[whole], row[: len(total)][whole]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            has = counts[short] > i
            extra[has] = mix(extra[has] + h[first[short[has]] + i])
        keys, rows = np.concatenate((keys, mix(extra + np.uint64(k)))), np.concatenate((rows, short))
        order = np.argsort(rows, kind="stable")
        keys, rows = keys[order], rows[order]
    return keys, rows


def distinct(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, key) pairs, sorted by row, then key."""
    order = np.lexsort((keys, rows))
    keys, rows = keys[order], rows[order]
    if len(keys):
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])))
        keys, rows = keys[new], rows[new]
    return keys, rows
