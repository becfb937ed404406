"""Count-min sketches of 64-bit hashes, built by tasks, merged by ranges of cells, sent to all executors.

Only "once" and "twice or more" matter, so counters saturate at two and the merged sketch is one bit a cell.  A task
sends, for each range of cells, the sorted cells it has hit as packed gaps (about a byte a hash), flushed at a bounded
number of hashes; one merging task holds the counters of its ranges alone.  Merged ranges are a written table, which the
driver reads a file partition at a time into the one array that it broadcasts, so it never holds the ranges twice.  The
result has a fixed size, at most DEPTH * 2**MAX_BITS / 8 bytes, whatever the corpus: with more hashes than cells it lets
more of them pass, never fewer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytekernels import lean, mix
from .store import drop, written

DEPTH = 2
MIN_BITS, MAX_BITS = 16, 28
RANGES = 64
FLUSH = 1_000_000
SKETCH_SCHEMA = "part int, once binary, more binary"


def bits_for(hashes: float) -> int:
    """Cells of a row (as a power of two): at least twice the number of hashes, within the fixed bounds."""
    return int(np.clip(np.ceil(np.log2(max(1.0, hashes) * 2)), MIN_BITS, MAX_BITS))


def cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Cell of each hash in a row of the sketch."""
    return (mix(hashes + np.uint64(row * 0x632BE59BD9B4E019 % 2**64)) >> np.uint64(64 - bits)).astype(np.int64)


def _pack(sorted_cells: np.ndarray) -> bytes:
    gaps = np.diff(sorted_cells, prepend=0).astype(np.uint32)
    wide = gaps >= 0xFFFF
    low = np.where(wide, 0xFFFF, gaps).astype(np.uint16)
    planes = np.concatenate([(low & 0xFF).astype(np.uint8), (low >> 8).astype(np.uint8)])
    return len(low).to_bytes(4, "little") + zstandard.compress(planes.tobytes() + gaps[wide].tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    raw = zstandard.decompress(data[4:])
    planes = np.frombuffer(raw[: 2 * n], np.uint8).astype(np.uint32)
    gaps = planes[:n] | (planes[n:] << np.uint32(8))
    gaps[gaps == 0xFFFF] = np.frombuffer(raw[2 * n :], np.uint32)
    return np.cumsum(gaps, dtype=np.int64)


def partition_sketch(hashes: Iterator[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of SKETCH_SCHEMA for the hashes of one task, for mapInArrow."""
    width = max(1, (1 << bits) // RANGES)

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found = np.concatenate(held)
        rows = []
        for row in range(DEPTH):
            at, n = np.unique(cells(found, row, bits), return_counts=True)
            edges = np.searchsorted(at, np.arange(RANGES + 1) * width)
            for k in range(RANGES):
                own, many = at[edges[k] : edges[k + 1]] - k * width, n[edges[k] : edges[k + 1]] > 1
                if len(own):
                    rows.append((row * RANGES + k, _pack(own[~many]), _pack(own[many])))
        if rows:
            a, b, c = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.binary()), pa.array(c, pa.binary())], ["part", "once", "more"])

    held, size = [], 0
    for h in hashes:
        held.append(h)
        size += len(h)
        if size >= FLUSH:
            yield from flush(held)
            held, size = [], 0
    if size:
        yield from flush(held)


#: A cell is hot if this many flushes of tasks have hit it; hot cells are told in runs of 2**HOT_SHIFT.
HOT, HOT_SHIFT = 64, 5


def merged(sketches: DataFrame, bits: int, hot: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """(DEPTH, cells / 8) packed bits: cells hit twice or more by all partition sketches together; hot: and the same,
    coarser, for cells that HOT flushes have hit."""
    width = max(1, (1 << bits) // RANGES)

    def merge(batches):
        state: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, once, more in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                count = state.setdefault(part, np.zeros(width, np.uint8))  # 128 and up: twice or more; below: flushes
                at = np.concatenate([_unpack(once.as_py()), many := _unpack(more.as_py())])
                n = count[at]
                count[at] = np.where(n > 0, 128, 0) | np.minimum((n & 127) + 1, HOT)
                count[many] |= 128
        for part, count in state.items():
            packed = [np.packbits(count >= 128, bitorder="little").tobytes()]
            if hot:
                packed.append(np.packbits(((count & 127) >= HOT).reshape(-1, 1 << HOT_SHIFT).any(1), bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([packed], pa.list_(pa.binary()))], ["part", "bits"])

    out = [np.zeros((DEPTH, (1 << b) // 8), np.uint8) for b in (bits, bits - HOT_SHIFT)[: 1 + hot]]
    ranges = written(sketches.repartition(DEPTH * RANGES, "part").mapInArrow(lean(merge), "part int, bits array<binary>"), "sketch")
    for r in ranges.toLocalIterator():  # of fixed size
        row, k = divmod(r["part"], RANGES)
        for table, packed in zip(out, r["bits"], strict=True):
            n = table.shape[1] // RANGES
            table[row, k * n : (k + 1) * n] = np.frombuffer(packed, np.uint8)
    drop(ranges)
    return out[0], out[1] if hot else None


def repeated(table: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """True where a hash may have occurred twice (never False where it did)."""
    ok = np.ones(len(hashes), bool)
    for row in range(DEPTH):
        at = cells(hashes, row, bits)
        ok &= (table[row][at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
    return ok


def build(df: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], expected: float, hot: bool = False) -> tuple[Broadcast, int]:
    """The merged sketch of the hashes that `hashes_of` yields for each batch of df, broadcast, and its bits.  With hot,
    the broadcast value is the pair of merged()."""
    bits = bits_for(expected)
    found = df.mapInArrow(lean(lambda batches: partition_sketch((h for b in batches for h in hashes_of(b)), bits)), SKETCH_SCHEMA)
    one, two = merged(found, bits, hot)
    return df.sparkSession.sparkContext.broadcast((one, two) if hot else one), bits


def frequent(table: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """True where very many tasks may have a hash (never False where HOT flushes have it); table: of hot cells."""
    return repeated(table, hashes, bits - HOT_SHIFT)


def total_bytes(df: DataFrame, column: str) -> float:
    """Bytes of a text column: one number."""
    return float(df.agg(F.sum(F.octet_length(F.col(f"`{column}`")))).first()[0] or 0)
