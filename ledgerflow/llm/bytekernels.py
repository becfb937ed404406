"""Vectorised kernels over the bytes of a batch of texts.

All functions take a text column as one uint8 buffer plus document offsets, so that a
document is a slice and nothing is done per character in Python.  Hashes are sums of
table values times odd powers modulo 2**64: a pure function of the content, equal on
every executor.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step takes; longer documents come in overlapping parts (word_slices, byte_slices).
SLICE_BYTES = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240611))
BYTE_VALUE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
_WORD_VALUES = [np.where(IS_SPACE, np.uint64(0), v) for v in (BYTE_VALUE, _RNG.integers(1, 2**64, 256, dtype=np.uint64))]
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_LOW_POWERS = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(65535, np.uint64(b))])) for b in _BASES]
_HIGH_BASES = [np.uint64(pow(b, 65536, 2**64)) for b in _BASES]
_STEP = np.uint64(0xD1342543DE82EF95)


def lean(run: Callable) -> Callable:
    """A function for mapInArrow that gives freed memory back to the system when its task ends: workers stay alive."""

    def then_trim(batches):
        yield from run(batches)
        trim()

    return then_trim


def trim() -> None:
    """Gives freed memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64, so that any bits of a hash can serve as a cell number."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count or pa.types.is_null(column.type):
        column = column.cast(pa.large_binary()) if pa.types.is_null(column.type) else column
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole documents."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_slices(data: np.ndarray, offsets: np.ndarray, size: int, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """slices() with the number of words before: a document over twice the limit comes in parts, cut at white space,
    that overlap by size - 1 words, so each window of `size` words lies whole in exactly one of them."""
    for row, end, part, places in slices(data, offsets, limit):
        if len(part) <= 2 * limit:
            yield row, end, part, places, 0
            continue
        begin, before, width = 0, 0, limit
        while True:
            stop = begin + width
            while stop < len(part) and not IS_SPACE[part[stop : stop + 65536]].any():
                stop += 65536
            stop = min(len(part), stop)
            if stop < len(part):
                stop += int(IS_SPACE[part[stop : stop + 65536]].argmax())
            edges = np.array([0, stop - begin])
            if stop == len(part):
                yield row, end, part[begin:stop], edges, before
                break
            starts, _, _ = word_bounds(part[begin:stop], edges)
            if len(starts) < 2 * size:  # very long words: a longer part
                width *= 2
                continue
            yield row, end, part[begin:stop], edges, before
            next_ = len(starts) - (size - 1)
            before += next_
            begin, width = begin + (int(starts[next_]) if size > 1 else stop - begin), limit


def byte_slices(data: np.ndarray, offsets: np.ndarray, size: int, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """slices() with the number of bytes before: a document over twice the limit comes in parts that overlap by
    size - 1 bytes, so each string of `size` bytes lies whole in exactly one of them."""
    for row, end, part, places in slices(data, offsets, limit):
        if len(part) <= 2 * limit:
            yield row, end, part, places, 0
            continue
        for begin in range(0, len(part) - size + 1, limit):
            piece = part[begin : begin + limit + size - 1]
            yield row, end, piece, np.array([0, len(piece)]), begin


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): words are runs without space or TAB..CR; document d has words first[d]:first[d + 1]."""
    inside = np.concatenate([[False], ~IS_SPACE[data], [False]])
    rises = inside[1:] & ~inside[:-1]
    falls = inside[:-1] & ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    both = edges[inside[edges] & inside[edges + 1]]  # a word can't go on in the next document
    rises[both] = True
    falls[both] = True
    starts, ends = np.flatnonzero(rises), np.flatnonzero(falls)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, which: int = 0) -> np.ndarray:
    """A uint64 for each word, of its bytes alone; which: 0 or 1, two independent hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    value = _WORD_VALUES[which][data[starts[0] :]] * _LOW_POWERS[which][place & 0xFFFF]
    if place.max(initial=0) > 0xFFFF:
        high = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(place.max()) >> 16, _HIGH_BASES[which])]))
        value *= high[place >> 16]
    return mix(np.add.reduceat(value, starts - starts[0]))


def window_hashes(items: np.ndarray, size: int) -> np.ndarray:
    """A uint64 for each run of `size` consecutive items, across document ends too; empty if there are fewer."""
    n = len(items) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, power = items[:n].copy(), np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(1, size):
            power = power * _STEP
            out += items[k : k + n] * power
    return mix(out)


def valid_windows(first: np.ndarray, size: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(start items, their documents) of the windows that lie in one document."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    docs = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    return np.arange(len(docs)) - begin[docs] + first[:-1][docs], docs


def byte_windows(data: np.ndarray, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Unmixed uint64 hashes of all byte strings of the given sizes, by start, built by doubling."""
    with np.errstate(over="ignore"):
        have = {1: BYTE_VALUE[data]}

        def power(k: int) -> np.uint64:
            return np.uint64(pow(int(_STEP), k, 2**64))

        def join(a: int, b: int) -> np.ndarray:
            n = max(0, len(data) - a - b + 1)
            return have[a][:n] + have[b][a : a + n] * power(a)

        p = 1
        while 2 * p <= max(sizes):
            have[2 * p] = join(p, p)
            p *= 2
        out = {}
        for size in sizes:
            at = 0
            for bit in (1 << b for b in reversed(range(size.bit_length())) if size >> b & 1):
                if at:
                    have[at + bit] = join(at, bit)
                at += bit
            out[size] = have[size]
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of `width` values, by doubling."""
    n, have = 1, values
    while 2 * n <= width:
        have = np.minimum(have[: len(have) - n], have[n:]) if len(have) > n else have[:0]
        n *= 2
    if n < width and len(have):
        have = np.minimum(have[: len(have) - (width - n)], have[width - n :]) if len(have) > width - n else have[:0]
    return have
