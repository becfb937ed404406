"""Token ids of whole texts by the tokenizers library, with each distinct piece of text encoded once.

A text is cut before white space that follows a character which surely isn't white space, after a line feed that
stands alone, and between ASCII letters and punctuation (but not after an apostrophe).  No pre-token of the two
vocabularies crosses such a place and no normalisation looks across it, so a text's ids are the ids of its pieces in
order.  Pieces repeat far more often than texts, so most come from a table that a worker keeps; new words are encoded
many to a call.  A special token's string in a text is a piece of its own, so it gets what the library gives it.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .bytekernels import IS_SPACE, SLICE_BYTES

#: Pieces and ids that a worker keeps at most; beyond that it starts a new table.
MAX_PIECES = 250_000
MAX_IDS = 2_500_000
#: New words that one call encodes together.
TOGETHER = 400

_SAFE_ASCII = np.zeros(256, bool)
_SAFE_ASCII[0x21:0x7F] = True
_LEAD_OF_TWO = np.zeros(256, bool)
_LEAD_OF_TWO[0xC3:0xE0] = True  # no white space character has one of these as the first of its two bytes
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[0x21:0x7F] = True
_MARK[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
#: A space and letters that every Unicode version has: one pre-token.
_WORD = re.compile(rb" (?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of pieces: of every non-empty text, and before white space after a safe character."""
    if not len(data):
        return np.zeros(0, np.int64)
    safe = _SAFE_ASCII[data]
    safe[1:] |= (data[1:] >= 0x80) & _LEAD_OF_TWO[data[:-1]]
    cut = np.zeros(len(data), bool)
    cut[1:] = IS_SPACE[data[1:]] & safe[:-1]
    letter, mark = _LETTER[data], _MARK[data]
    cut[1:] |= letter[:-1] & mark[1:]
    cut[1:] |= mark[:-1] & (data[:-1] != 0x27) & letter[1:]
    cut[2:] |= safe[:-2] & (data[1:-1] == 0x0A) & letter[2:]
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(cut)


class PieceTable:
    """Ids of pieces of text, each encoded once; subclasses say where texts are cut and how pieces are encoded."""

    def __init__(self):
        self._clear()

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of ids of each)."""
        raise NotImplementedError

    def _clear(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)  # ends[s] is where the ids of slot s end; slot 0 is empty
        self.used = 1

    def _add(self, pieces: list[bytes]) -> None:
        flat, sizes = self.encode_pieces(pieces)
        ends = self.ends[self.used - 1] + np.cumsum(sizes)
        while len(self.ends) < self.used + len(ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while len(self.ids) < ends[-1]:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.ends[self.used - 1] : ends[-1]] = flat
        self.ends[self.used : self.used + len(ends)] = ends
        self.slots.update(zip(pieces, range(self.used, self.used + len(pieces)), strict=True))
        self.used += len(ends)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of each text in them)."""
        starts = self.starts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if self.used > MAX_PIECES or self.ends[self.used - 1] > MAX_IDS:
            self._clear()
        found, sizes, at = [], [], 0
        while at < len(starts):  # about SLICE_BYTES of pieces at a time, however long a text is
            end = max(at + 1, int(np.searchsorted(starts, starts[at] + SLICE_BYTES)))
            ids, size = self._encode_run(data[starts[at] : starts[end] if end < len(starts) else len(data)], starts[at:end] - starts[at])
            found.append(ids)
            sizes.append(size)
            at = end
        total = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return np.concatenate(found), total[np.searchsorted(starts, offsets)]

    def _encode_run(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of pieces that lie one after another, number of ids of each)."""
        edges = np.append(starts, len(data)).astype(np.int32 if len(data) < 2**31 else np.int64)
        kind = pa.binary() if edges.dtype == np.int32 else pa.large_binary()
        pieces = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        get = self.slots.get
        if missing := [p for p in distinct if get(p) is None]:
            self._add(missing)
        slot = np.fromiter(map(self.slots.__getitem__, distinct), np.int64, len(distinct))[pieces.indices.to_numpy(zero_copy_only=False)]
        begin, size = self.ends[slot - 1], self.ends[slot] - self.ends[slot - 1]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.ids[np.repeat(begin - total[:-1], size) + np.arange(total[-1])], size

    def encode_with_end(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """encode(), with end_id after each text."""
        ids, places = self.encode(data, offsets)
        n = len(offsets) - 1
        return np.insert(ids, places[1:], np.full(n, end_id, np.uint32)), places + np.arange(n + 1)


class PieceEncoder(PieceTable):
    """Pieces by a vocabulary file of the tokenizers library.  special_as_text: strings of special tokens in a text are
    ordinary text; else they are the special tokens, as the library has it by default."""

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added):
            raise ValueError(f"{path} has added tokens that depend on the text around them")
        names = sorted((t.content.encode() for t in added if not (special_as_text and t.special)), key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, names))) if names else None
        self.prefix = os.path.commonprefix(names)
        self._marks()
        super().__init__()

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        found = piece_starts(data, offsets)
        blob = data.tobytes() if self.special else b""
        if not self.special or self.prefix not in blob or not self.special.search(blob):
            return found
        edges = offsets.tolist()
        spans = [m.span() for a, b in zip(edges[:-1], edges[1:], strict=True) for m in self.special.finditer(blob, a, b)]
        if not spans:
            return found
        begin, end = np.array(spans).T
        inside = np.searchsorted(begin, found, "right") - 1
        found = found[(inside < 0) | (found >= end[inside])]
        return np.unique(np.concatenate([found, begin, end[end < len(data)]]))

    def _marks(self) -> None:
        """Which ids begin (or end) a word, by the vocabulary's own convention, if it has one."""
        vocab = self.tokenizer.get_vocab()
        self.ends_word = any(k.endswith("</w>") for k in vocab)
        self.mark = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.mark[i] = token.endswith("</w>") if self.ends_word else token.startswith("Ġ")

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        word = _WORD.fullmatch
        plain = [i for i, p in enumerate(pieces) if word(p)]
        parts = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        joined = [b"".join([pieces[i] for i in part]).decode() for part in parts]
        rest: list[int] = sorted(set(range(len(pieces))) - set(plain))
        sizes = np.zeros(len(pieces), np.int64)
        found: list[tuple[list[int], np.ndarray]] = []
        for part, e in zip(parts, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            at = np.flatnonzero(self.mark[ids])
            if len(at) != len(part):
                rest += part
                continue
            sizes[part] = np.diff(at, prepend=-1) if self.ends_word else np.diff(at, append=len(ids))
            found.append((part, ids))
        lists = [e.ids for e in self.tokenizer.encode_batch_fast([pieces[i].decode("utf-8", "replace") for i in rest], add_special_tokens=False)]
        sizes[rest] = [len(x) for x in lists]
        found.append((rest, np.fromiter((i for x in lists for i in x), np.uint32)))
        out = np.empty(int(sizes.sum()), np.uint32)
        begin = np.cumsum(sizes) - sizes
        for part, ids in found:
            n = sizes[part]
            out[np.repeat(begin[part] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, sizes


@lru_cache(maxsize=4)
def encoder(path: str, special_as_text: bool = False) -> PieceEncoder:
    """One for each vocabulary and worker."""
    return PieceEncoder(path, special_as_text)
