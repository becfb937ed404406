"""Token ids as raw binary shards with a minimal perfect hash index.

A shard is two files in a shared folder: `.ids`, the little-endian unsigned ids of its documents in ascending
doc_id order with nothing between them (16 bits each where the vocabulary allows, else 32), and `.index`, a minimal perfect hash of its document keys.  The hash gives a
key's slot from a few bits and a rank; the slot holds a fingerprint, the key's first row and its number of rows; the
row table holds the places of the ids.  A lookup touches a constant number of cells and one range of the payload.

Shards are ranges of doc_id, so the ids of all documents before one are those of the shards before it and of the rows
before it in its own.  A task streams its ids to the file and keeps only keys and places.
"""

from __future__ import annotations

import io
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytekernels import lean, mix, slices, text_buffer
from .store import new_path, written
from .tokens import encoder

#: Cells for each key and hash level; keys that share a cell go to the next level, those left after all to a sorted list.
CELLS_A_KEY = 1.5
LEVELS = 24
BLOCK_IDS = 1 << 20
MANIFEST = "shard int, ids_uri string, index_uri string, id_bytes int, n_docs long, n_tokens long, first_key long, last_key long, n_null long"


def _hash(keys: np.ndarray, nulls: np.ndarray, seed: int) -> np.ndarray:
    salt = np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)
    return mix(mix(keys.astype(np.int64).view(np.uint64) + salt) ^ (nulls.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))


class PerfectHash:
    """Levels of bits: a key sits at the first level where no other key has its cell; its slot is the rank of that bit."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, rest_keys: np.ndarray, rest_nulls: np.ndarray):
        self.bits, self.sizes, self.rest_keys, self.rest_nulls = bits, sizes, rest_keys, rest_nulls
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        self.rank = np.concatenate([[0], np.cumsum(np.unpackbits(bits, bitorder="little").reshape(-1, 64).sum(1))]) if len(bits) else np.zeros(1, np.int64)

    @staticmethod
    def build(keys: np.ndarray, nulls: np.ndarray) -> PerfectHash:
        """keys and null flags: distinct pairs."""
        levels, sizes = [], []
        while len(keys) and len(sizes) < LEVELS:
            size = max(64, int(len(keys) * CELLS_A_KEY))
            cell = (_hash(keys, nulls, len(sizes) + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(cell, minlength=size) == 1
            levels.append(alone)
            sizes.append(size)
            left = ~alone[cell]
            keys, nulls = keys[left], nulls[left]
        flat = np.concatenate(levels) if levels else np.zeros(0, bool)
        flat = np.concatenate([flat, np.zeros(-len(flat) % 64, bool)])
        return PerfectHash(np.packbits(flat, bitorder="little"), np.array(sizes, np.int64), keys, nulls)

    def slots(self, keys: np.ndarray, nulls: np.ndarray) -> np.ndarray:
        """Slot of each key that was built in (0 to n - 1, all different); any slot or -1 for other keys."""
        out = np.full(len(keys), -1, np.int64)
        live = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(live):
                break
            cell = self.begin[level] + (_hash(keys[live], nulls[live], level + 1) % np.uint64(size)).astype(np.int64)
            here = (self.bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0
            hit = cell[here]
            word = self.bits.view(np.uint64)[hit >> 6]
            below = word & ((np.uint64(1) << (hit & 63).astype(np.uint64)) - np.uint64(1))
            out[live[here]] = self.rank[hit >> 6] + np.bitwise_count(below)
            live = live[~here]
        for at in live:
            same = np.flatnonzero((self.rest_keys == keys[at]) & (self.rest_nulls == nulls[at]))
            if len(same):
                out[at] = self.rank[-1] + same[0]
        return out


def build_index(keys: np.ndarray, nulls: np.ndarray, places: np.ndarray) -> bytes:
    """The .index file of rows in ascending order of key (nulls first), with their places in the payload."""
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (nulls[1:] != nulls[:-1])]) if len(keys) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    hashed = PerfectHash.build(keys[first], nulls[first])
    slot = hashed.slots(keys[first], nulls[first])
    row, count, print_ = np.zeros(len(first), np.uint32), np.zeros(len(first), np.uint32), np.zeros(len(first), np.uint32)
    row[slot] = first
    count[slot] = np.diff(np.append(first, len(keys)))
    print_[slot] = (_hash(keys[first], nulls[first], 0) >> np.uint64(32)).astype(np.uint32)
    out = io.BytesIO()
    np.savez(out, bits=hashed.bits, sizes=hashed.sizes, rest_keys=hashed.rest_keys, rest_nulls=hashed.rest_nulls, row=row, count=count, fingerprint=print_, keys=keys, nulls=nulls, places=places)
    return out.getvalue()


class TokenShard:
    """Keyed reads of one shard."""

    def __init__(self, ids_uri: str, index_uri: str, id_bytes: int):
        self.id_bytes = id_bytes
        system, path = pafs.FileSystem.from_uri(index_uri)
        with system.open_input_file(path) as f:
            found = np.load(io.BytesIO(f.read()))
        self.row, self.count, self.fingerprint = found["row"], found["count"], found["fingerprint"]
        self.keys, self.nulls, self.places = found["keys"], found["nulls"], found["places"]
        self.hashed = PerfectHash(found["bits"], found["sizes"], found["rest_keys"], found["rest_nulls"])
        system, path = pafs.FileSystem.from_uri(ids_uri)
        self.file = system.open_input_file(path)

    def close(self) -> None:
        self.file.close()

    def find(self, keys: np.ndarray, nulls: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(first row, number of rows) of each key; 0 rows for a key that isn't here."""
        keys = np.asarray(keys, np.int64)
        nulls = np.zeros(len(keys), bool) if nulls is None else nulls
        slot = self.hashed.slots(keys, nulls)
        good = slot >= 0
        at = np.where(good, slot, 0)
        if not len(self.row):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        good &= self.fingerprint[at] == (_hash(keys, nulls, 0) >> np.uint64(32)).astype(np.uint32)
        row = self.row[at].astype(np.int64)
        good &= (self.keys[row] == keys) & (self.nulls[row] == nulls)  # a chance match of fingerprints ends here
        return np.where(good, row, 0), np.where(good, self.count[at].astype(np.int64), 0)

    def ids(self, row: int, end: int | None = None) -> np.ndarray:
        """The ids of a row, or of rows row:end."""
        a, b = int(self.places[row]), int(self.places[row + 1 if end is None else end])
        self.file.seek(self.id_bytes * a)
        return np.frombuffer(self.file.read(self.id_bytes * (b - a)), f"<u{self.id_bytes}").astype("<u4")


def write_token_shards(df: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Writes the shards; returns their manifest, written and reread: shard, ids_uri, index_uri, id_bytes, n_docs, n_tokens, the
    first and last key and the number of rows without one.

    Rows are in ascending order of doc_id, null first, equal ids by text; a null text is empty and has the end id alone;
    repeated rows are rows.  Texts of any length are encoded whole, strings of special tokens in them as those tokens (as
    the tokenizers library has it by default), and other columns aren't looked at.  A task that is run again writes its own files, and the manifest names those of the attempt that counts.  An empty
    table gives an empty manifest.
    """
    folder = new_path(df.sparkSession, "token-shards")

    def write(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        system, base = pafs.FileSystem.from_uri(folder)
        name = f"{shard:06d}-{uuid.uuid4().hex}"
        keys, nulls, sizes, stream = [], [], [np.zeros(1, np.int64)], None
        width = 2 if max(encoder(tokenizer_path).tokenizer.get_vocab_size(), end_id + 1) <= 65536 else 4
        for batch in batches:
            if not batch.num_rows:
                continue
            if stream is None:
                system.create_dir(base, recursive=True)
                stream = system.open_output_stream(f"{base}/{name}.ids")
            column = batch.column(0)
            nulls.append(column.is_null().to_numpy(zero_copy_only=False))
            keys.append(column.fill_null(0).to_numpy())
            data, offsets = text_buffer(batch.column(1))
            for _, _, part, places in slices(data, offsets):
                ids, ends = encoder(tokenizer_path).encode_with_end(part, places, end_id)
                stream.write(ids.astype(f"<u{width}").tobytes())
                sizes.append(np.diff(ends))
        if stream is None:
            return
        stream.close()
        places = np.cumsum(np.concatenate(sizes))
        with system.open_output_stream(f"{base}/{name}.index") as f:
            f.write(build_index(np.concatenate(keys), np.concatenate(nulls), places))
        none = np.concatenate(nulls)
        known = np.concatenate(keys)[~none]  # ascending
        ends = [int(known[0]), int(known[-1])] if len(known) else [None, None]
        cols = [shard, f"{folder}/{name}.ids", f"{folder}/{name}.index", width, len(places) - 1, int(places[-1]), *ends, int(none.sum())]
        kinds = (pa.int32(), pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 5)
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cols, kinds, strict=True)], [c.split()[0] for c in MANIFEST.split(", ")])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").alias("t"))
    rows = rows.repartitionByRange(shards, "i") if shards else rows.repartitionByRange("i")
    rows = rows.sortWithinPartitions("i", "t")
    return written(rows.mapInArrow(lean(write), MANIFEST), "token-manifest")


def read_token_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard of every row.  Each key is looked up in its shard's index, which must give
    all rows in order (else ValueError); the payload is then read in that order, a block at a time."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def read(batches):
        for batch in batches:
            for shard, ids_uri, index_uri, id_bytes, base in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                open_ = TokenShard(ids_uri, index_uri, id_bytes)
                first = np.flatnonzero(np.concatenate([[True], (open_.keys[1:] != open_.keys[:-1]) | (open_.nulls[1:] != open_.nulls[:-1])]))
                row, count = open_.find(open_.keys[first], open_.nulls[first])
                rows = np.repeat(row - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                if not np.array_equal(rows, np.arange(len(open_.keys))):
                    raise ValueError(f"the index of {ids_uri} doesn't give back its keys")
                at = 0
                while at < len(rows):
                    end = max(at + 1, int(np.searchsorted(open_.places, open_.places[rows[at]] + BLOCK_IDS, "right")) - 1)
                    end = min(end, len(rows), at + 50_000)
                    block = open_.ids(int(rows[at]), int(rows[end - 1]) + 1)
                    places = open_.places[rows[at] : rows[end - 1] + 2] - open_.places[rows[at]]
                    view, edges = memoryview(block.tobytes()), (4 * places).tolist()
                    crc = [zlib.crc32(view[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                    span = slice(int(rows[at]), int(rows[end - 1]) + 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(open_.keys[span], mask=open_.nulls[span]), pa.array(open_.places[span] + base), pa.array(np.diff(places)), pa.array(crc, pa.int64()), pa.array(np.full(end - at, shard, np.int32))],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "shard"],
                    )
                    at = end
                open_.close()

    spread = based.select("shard", "ids_uri", "index_uri", "id_bytes", "base").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4))
    return spread.mapInArrow(lean(read), "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def lookup(spark: SparkSession, manifest: DataFrame, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """doc_id, ids of every row whose key is asked, rows without a key too if null is; a key that isn't there has no row.

    The manifest (a row a shard) says which shard holds a key, so a key goes to that one alone, and a task opens each of
    its shards once.
    """
    table = sorted(tuple(r) for r in manifest.select("shard", "ids_uri", "index_uri", "id_bytes", "first_key", "last_key", "n_null").collect())
    keyed = [i for i, r in enumerate(table) if r[4] is not None]
    first, last = (np.array([table[i][c] for i in keyed], np.int64) for c in (4, 5))
    without = next((i for i, r in enumerate(table) if r[6]), -1)

    def deal(batches):
        for batch in batches:
            none = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            key = batch.column(0).fill_null(0).to_numpy()
            at = np.searchsorted(last, key)
            there = ~none & (at < len(keyed))
            there[there] &= key[there] >= first[at[there]]
            shard = np.full(len(key), without)
            shard[~none] = -1
            shard[there] = np.array(keyed, np.int64)[at[there]]
            use = shard >= 0
            yield pa.RecordBatch.from_arrays([pa.array(shard[use].astype(np.int32)), pa.array(key[use], mask=none[use])], ["s", "k"])

    def read(batches):
        at, open_ = -1, None
        for batch in batches:
            shard = batch.column(0).to_numpy()
            none = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            key = batch.column(1).fill_null(0).to_numpy()
            for s in np.unique(shard).tolist():
                if s != at:
                    if open_:
                        open_.close()
                    at, open_ = s, TokenShard(*table[s][1:4])
                own = shard == s
                row, count = open_.find(key[own], none[own])
                rows = np.repeat(row - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                names = pa.array(np.repeat(key[own], count), mask=np.repeat(none[own], count))
                until = np.cumsum(open_.places[rows + 1] - open_.places[rows])
                begin = 0
                while begin < len(rows):
                    end = max(begin + 1, int(np.searchsorted(until, (until[begin - 1] if begin else 0) + BLOCK_IDS, "right")))
                    found = [open_.ids(int(r)).astype(np.int64) for r in rows[begin:end]]
                    edges = np.cumsum([0, *map(len, found)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([names.slice(begin, end - begin), pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(found)))], ["doc_id", "ids"])
                    begin = end
        if open_:
            open_.close()

    asked = keys.select(F.col(f"`{key_col}`").cast("long").alias("k")).distinct()
    dealt = asked.mapInArrow(deal, "s int, k long").repartition("s").sortWithinPartitions("s", "k")
    return dealt.mapInArrow(lean(read), "doc_id long, ids array<long>")
