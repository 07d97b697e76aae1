"""Vectorised scanning of Arrow string columns: words, hashes and slices without Python strings.

All functions work on the UTF-8 bytes of many documents at once. ``slices``
cuts a column into runs of documents of a few MB, so that memory stays bounded
whatever the batch size; one document is never cut. Where a hash alone would
decide, ``distinct`` and ``same_bytes`` compare the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text handled at once (a longer document is handled alone).
SLICE_BYTES = 1 << 20

#: Byte ranges from this length on are hashed one by one.
LONG = 512
_SEED, _FACTOR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Masks that keep the first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lut(*ranges: tuple[int, int]) -> np.ndarray:
    """Booleans by byte: true inside the inclusive ranges."""
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Everything but space and 0x09-0x0D.
NOT_SPACE = ~lut((0x20, 0x20), (0x09, 0x0D))
#: Digits, lower-case letters and all that is not ASCII.
ALNUM = lut((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits (in place)."""
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(33)
    return h


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of documents; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE_BYTES, side="right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first span of each document and the total) of maximal runs of bytes that are ``inside``."""
    if not len(data):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(len(offsets), dtype=np.int64)
    flags = np.zeros(len(data) + 1, dtype=bool)
    flags[:-1] = inside[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = flags[:-1]
    starts = np.flatnonzero(flags & (~before | edge))
    ends = np.flatnonzero(before & (~flags | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position of the data on as one number, zeros after the end."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; equal bytes give equal hashes wherever they stand.

    Every eight bytes are mixed in by a bijection that is not linear, so no
    structure of the text makes ranges collide, only chance does.
    """
    starts, lengths = np.asarray(starts, dtype=np.int64), np.asarray(ends, dtype=np.int64) - np.asarray(starts, dtype=np.int64)
    h = lengths.astype(np.uint64) * _FACTOR ^ _SEED
    if not len(h):
        return h
    at = _words(data)
    long = lengths >= LONG
    own = np.flatnonzero((lengths > 0) & ~long)
    done = 0
    while len(own):
        left = lengths[own] - done
        chunk = at[starts[own] + done] & _FIRST[np.minimum(left, 8)]
        h[own] = mix((h[own] ^ chunk) * _FACTOR + _SEED)
        own, done = own[left > 8], done + 8
    for i in np.flatnonzero(long).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + lengths[i]])
    return h


def same_bytes(data: np.ndarray, starts: np.ndarray, others: np.ndarray, lengths: np.ndarray) -> bool:
    """Whether every range of ``lengths`` bytes from ``starts`` equals the one from ``others``."""
    at = _words(data)
    own = np.flatnonzero((starts != others) & (lengths > 0) & (lengths < LONG))
    done = 0
    while len(own):
        left = lengths[own] - done
        if ((at[starts[own] + done] ^ at[others[own] + done]) & _FIRST[np.minimum(left, 8)]).any():
            return False
        own, done = own[left > 8], done + 8
    far = np.flatnonzero((starts != others) & (lengths >= LONG)).tolist()
    return all(np.array_equal(data[starts[i] : starts[i] + lengths[i]], data[others[i] : others[i] + lengths[i]]) for i in far)


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, mark: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index of one range of each distinct content, which of them every range is), compared byte by byte.

    ``mark`` (booleans) keeps ranges of equal bytes apart.
    """
    lengths = ends - starts
    h = hashes(data, starts, ends)
    if mark is not None:
        h = np.where(mark, mix(h ^ _FACTOR), h)
    _, where, which = np.unique(h, return_index=True, return_inverse=True)
    found = where[which]
    apart = (lengths[found] != lengths).any() or (mark is not None and (mark[found] != mark).any())
    if apart or not same_bytes(data, starts, starts[found], lengths):
        seen: dict[tuple, int] = {}
        names = [(bool(mark is not None and mark[i]), data[a:b].tobytes()) for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True))]
        which = np.array([seen.setdefault(x, len(seen)) for x in names], dtype=np.int64)
        where = np.unique(which, return_index=True)[1]
    return where, which


def chained(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive hashes (empty for fewer)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(m, n, dtype=np.uint64)
    for k in range(n):
        out = mix((out ^ h[k : k + m]) * _FACTOR + _SEED)
    return out


def by_document(values: np.ndarray, bounds: np.ndarray, ufunc: np.ufunc, empty: float) -> np.ndarray:
    """``ufunc`` reduced over values[bounds[i]:bounds[i+1]], ``empty`` where there is none."""
    out = np.full(len(bounds) - 1, empty, dtype=np.float64)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = ufunc.reduceat(values, bounds[:-1][full])
    return out
