"""Words, word shingles and string fingerprints of many texts at once, on numpy arrays.

Texts are taken as one run of UTF-8 bytes with offsets, as Arrow stores them. A fingerprint of bytes
b_s..b_e is a polynomial sum modulo 2^64 over random values of the bytes, read off a running total,
so every substring costs the same. All fingerprints have 64 bits.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK = 1 << 20  # bytes fingerprinted at a time
SHINGLE = 5


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's published constants): near inputs become far apart."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mixed(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + mixed(np.array([seed], U64)))


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    up = np.concatenate((np.ones(1, U64), np.multiply.accumulate(np.full(CHUNK, BASE, U64))))
    down = np.concatenate((np.ones(1, U64), np.multiply.accumulate(np.full(CHUNK, INVERSE, U64))))
    return up, down


@lru_cache(maxsize=2)
def byte_values(lower: bool) -> np.ndarray:
    values = stream(17, 256)
    if lower:
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


def running(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Running totals of at most CHUNK bytes; `between` reads fingerprints off them."""
    total = np.empty(len(data) + 1, U64)
    total[0] = 0
    np.cumsum(byte_values(lower)[data] * powers()[0][: len(data)], out=total[1:])
    return total


def between(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((total[end] - total[start]) * powers()[1][start])


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary column and the offsets of its rows; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@lru_cache(maxsize=1)
def blank_bytes() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word `[^\\x20\\x09-\\x0D]+`."""
    n = len(data)
    inside = ~blank_bytes()[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    begins = cuts[cuts < n]
    first[begins] |= inside[begins]
    ends = cuts[cuts > 0] - 1
    last[ends] |= inside[ends]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, side="right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """Fingerprints of the words, some CHUNK bytes of text at a time."""
    out = np.empty(len(start), U64)
    at = 0
    while at < len(start):
        low = start[at]
        to = max(at + 1, np.searchsorted(end, low + CHUNK, side="right"))
        if end[to - 1] - low <= CHUNK:
            total = running(data[low : end[to - 1]], lower)
            out[at:to] = between(total, start[at:to] - low, end[at:to] - low)
        else:  # one word longer than a chunk: fold the fingerprints of its chunks
            folded = U64(0)
            for p in range(low, end[at], CHUNK):
                piece = running(data[p : min(end[at], p + CHUNK)], lower)
                folded = mixed(between(piece, np.array([0]), np.array([len(piece) - 1])) + np.array([folded]) * U64(3))[0]
            out[at] = folded
        at = to
    return out


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of every `width` words in a row."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(n, U64)
    for k, factor in enumerate(stream(29, width) | U64(1)):
        total += hashes[k : k + n] * factor
    return mixed(total)


def shingles(hashes: np.ndarray, row: np.ndarray, n_rows: int, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle fingerprints of all rows one after another, and their offsets by row.

    A row of fewer words than `width` has its whole sequence as the one shingle; without words none.
    """
    count = np.bincount(row, minlength=n_rows)
    begin = np.concatenate(([0], np.cumsum(count)))
    size = np.where(count >= width, count - width + 1, (count > 0).astype(count.dtype))
    offsets = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(offsets[-1], U64)
    full = windows(hashes, width)
    whole = np.flatnonzero(count >= width)
    if len(whole):
        at = np.repeat(begin[whole] - offsets[whole], size[whole]) + np.concatenate([np.arange(offsets[r], offsets[r + 1]) for r in whole])
        target = np.concatenate([np.arange(offsets[r], offsets[r + 1]) for r in whole])
        out[target] = full[at]
    for short in range(1, width):
        rows = np.flatnonzero(count == short)
        if len(rows):
            out[offsets[rows]] = windows(hashes, short)[begin[rows]] ^ U64(short)
    return out, offsets


def slices(offsets: np.ndarray, limit: int = CHUNK):
    """Runs of rows [a, b) of about `limit` bytes; a longer row is a run of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, min(to, n)
        at = to
