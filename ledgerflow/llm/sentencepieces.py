"""SentencePiece encoding and decoding by suffix-array matching.

The distinct pieces of text of a batch (a run of spaces and what follows) are concatenated and indexed by a suffix
array as deep as the longest vocabulary entry.  Every entry is searched for its range of suffixes; the occurrences are
the edges of a lattice, sorted by position.  Edges are then relaxed by rank: in each round every word takes its best
edge that spans exactly two of its current symbols (the leftmost of equals), which is the merge order of the
vocabulary, until none is left.  Characters without an entry fall back to bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytekernels import slices, text_buffer
from .tokens import PieceTable

SPACE = "▁"
_SPACE_BYTES = SPACE.encode()


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of text (small non-negative ints) in the order of the `depth` items that start there, by doubling."""
    rank, have = text.astype(np.int64), 1
    while have < depth:
        after = np.concatenate([rank[have:], np.zeros(min(have, len(rank)), np.int64)])[: len(rank)]
        key = rank * (int(rank.max(initial=0)) + 1) + after
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[0], (np.diff(key[order]) > 0).astype(np.int64)])
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(step)
        have *= 2
    return np.argsort(rank, kind="stable")


class SentencePieces(PieceTable):
    """Encoding and decoding with a BPE model file; the library only reads the vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.byte_id = np.zeros(256, np.uint32)
        raw = [names[i].replace(SPACE, " ").encode() for i in range(size)]
        for i in range(size):
            if model.is_byte(i):
                self.byte_id[int(names[i][1:-1], 16)] = i
                raw[i] = bytes([int(names[i][1:-1], 16)])
            elif model.is_control(i):
                raw[i] = b""
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_ends = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        letters = sorted({c for i in plain for c in names[i]})
        #: Characters as small numbers: 0 ends a word, 1 is any character that no entry has.
        self.letters = np.array([ord(c) for c in letters])
        place = {c: k + 2 for k, c in enumerate(letters)}
        self.depth = max(len(names[i]) for i in plain)
        self.single = np.full(len(letters) + 2, -1, np.int64)
        for i in plain:
            if len(names[i]) == 1:
                self.single[place[names[i]]] = i
        longer = [i for i in plain if len(names[i]) > 1]
        self.entry = np.array(longer, np.int64)
        self.size = np.array([len(names[i]) for i in longer])
        self.score = np.array([model.get_score(i) for i in longer])
        low = np.zeros((len(longer), self.depth), np.uint32)
        for k, i in enumerate(longer):
            low[k, : len(names[i])] = [place[c] for c in names[i]]
        high = low.copy()
        high[np.arange(self.depth)[None, :] >= self.size[:, None]] = len(letters) + 2
        self.low, self.high = (np.ascontiguousarray(x).view(f"<U{self.depth}").ravel() for x in (low, high))
        super().__init__()

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not len(data):
            return np.zeros(0, np.int64)
        cut = np.zeros(len(data), bool)
        cut[1:] = (data[1:] == 0x20) & (data[:-1] != 0x20)
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(cut)

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, entries) of the occurrences of all entries, by place."""
        order = suffix_order(text, self.depth)
        padded = np.concatenate([text, np.zeros(self.depth, text.dtype)]).astype(np.uint32)
        found = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, self.depth)[order]).view(f"<U{self.depth}").ravel()
        a, b = np.searchsorted(found, self.low, "left"), np.searchsorted(found, self.high, "right")
        count = b - a
        at = order[np.repeat(a - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
        entry = np.repeat(np.arange(len(count)), count)
        by_place = np.argsort(at, kind="stable")
        return at[by_place], entry[by_place]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words = [p.decode("utf-8", "replace").replace(" ", SPACE) for p in pieces]
        point = np.frombuffer("\0".join(words).encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(size + 1) - (size + 1)
        k = np.minimum(np.searchsorted(self.letters, point), len(self.letters) - 1)
        text = np.where(self.letters[k] == point, k + 2, 1)
        text[begin[1:] - 1] = 0
        word = np.repeat(np.arange(len(words)), size + 1)[: len(text)]
        at, entry = self.edges(text)
        end = at + self.size[entry]
        # best first in each word, the leftmost of equals
        order = np.lexsort((at, -self.score[entry], word[at]))
        at, end, entry = at[order], end[order], entry[order]
        follow = np.arange(len(text) + 1) + 1  # where the symbol that starts here ends; 0 inside a symbol
        symbol = self.single[text]
        while len(at):
            live = (follow[at] > 0) & (follow[np.minimum(end, len(text))] > 0)  # both ends are still ends of symbols
            at, end, entry = at[live], end[live], entry[live]
            middle = follow[at]
            fits = np.flatnonzero((middle < end) & (follow[np.minimum(middle, len(text))] == end))
            if not len(fits):
                break
            own = word[at[fits]]
            best = fits[np.concatenate([[True], own[1:] != own[:-1]])]
            follow[middle[best]] = 0
            follow[at[best]] = end[best]
            symbol[at[best]] = self.entry[entry[best]]
            going = np.zeros(len(words), bool)
            going[own] = True
            keep = going[word[at]]  # a word without a fitting edge is done
            keep[best] = False
            at, end, entry = at[keep], end[keep], entry[keep]
        alive = np.flatnonzero((follow[:-1] > 0) & (text > 0))
        ids = symbol[alive]
        many = np.ones(len(alive), np.int64)
        strange = np.flatnonzero(ids < 0)
        raw = [chr(c).encode("utf-8", "replace") for c in point[alive[strange]].tolist()]
        many[strange] = [len(r) for r in raw]
        out = np.repeat(ids, many)
        if raw:
            out[out < 0] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        return out.astype(np.uint32), np.bincount(word[alive], weights=many, minlength=len(words)).astype(np.int64)

    def encode_texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): a space stands before each text that isn't empty."""
        full = np.flatnonzero(np.diff(offsets) > 0)
        shifted = offsets + np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])
        return self.encode(np.insert(data, offsets[full], np.full(len(full), 0x20, np.uint8)), shifted)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The text of each run of ids, without the space that encoding puts first."""
        size = np.diff(self.raw_ends)[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = self.raw[np.repeat(self.raw_ends[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        edges = ends[offsets].tolist()
        return [flat[a + (flat[a : a + 1] == b" ") : b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


@lru_cache(maxsize=2)
def pieces_of(path: str) -> SentencePieces:
    return SentencePieces(path)


def encode_decode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of little-endian unsigned 32-bit ids), decoded_sha256, round_trip (and ids).

    The decoded text is the text with U+2581 as a space, as the model knows no other.  A null text is empty and has no
    ids.  Repeated rows get equal results, rows without an id keep a null, an empty table gives an empty one, and other
    columns of df, whatever their names, are left out.  Texts of any length are encoded whole, a megabyte of new pieces at
    a time; of equally good merges the leftmost is done first, as the library does it.
    """
    schema = "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean" + ", ids array<long>" * keep_ids

    def run(batches):
        table = pieces_of(model_path)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b, part, places in slices(data, offsets):
                blob, edges = part.tobytes(), places.tolist()
                texts = [blob[x:y] for x, y in zip(edges[:-1], edges[1:], strict=True)]
                if _SPACE_BYTES in blob:
                    texts = [t.replace(_SPACE_BYTES, b" ") for t in texts]
                    part = np.frombuffer(b"".join(texts), np.uint8)
                    places = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
                ids, ends = table.encode_texts(part, places)
                back = table.decode(ids, ends)
                view, cut = memoryview(ids.astype("<u4", copy=False).tobytes()), (4 * ends).tolist()
                cols = [batch.column(0).slice(a, b - a), pa.array(np.diff(ends)), pa.array([zlib.crc32(view[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.int64())]
                cols += [pa.array([hashlib.sha256(t).hexdigest() for t in back]), pa.array([x == y for x, y in zip(back, texts, strict=True)], pa.bool_())]
                if keep_ids:
                    cols.append(pa.array([ids[x:y].tolist() for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "round_trip", "ids"][: len(cols)])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").alias("t"))
    return rows.mapInArrow(run, schema)
