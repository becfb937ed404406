"""Periodic run detection: maximal stretches of consecutive words that repeat with a period.

Method: harmonic grid.  A run of period p and length 2p or more covers two neighbours jp and (j+1)p of the grid of p, so
for each period the common extensions of such pairs, forward and backward, give all of its runs: n/p pairs for each
period, n log n for all.  Extensions are range minima over the common prefixes of neighbours in a suffix array, backward
ones over that of the reversed words.  Texts are laid end to end with a separator of its own before each, so the pairs of
all texts and periods of a batch are a few array operations.  Pairs that can't lie in a long enough run (no three equal
words to the left or right) need no extension, and texts without pairs that can no suffix array.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytekernels import lean, text_buffer

#: Words that one vectorised step takes; a longer text is a step of its own.
STEP_WORDS = 1 << 18


@dataclass(frozen=True)
class RunRules:
    """least_length: words of the shortest run; every run has two periods at least.  10 or more, so that a run of any
    period has pairs with three equal words beside them."""

    least_length: int = 12

    def __post_init__(self):
        if self.least_length < 10:
            raise ValueError("least_length must be 10 or more")


def _ranks(items: np.ndarray) -> list[np.ndarray]:
    """Order of the substrings of 1, 2, 4, ... items at each place (shorter ones at the end first), by doubling, until all
    differ."""
    n = len(items)
    out = [np.unique(items, return_inverse=True)[1].astype(np.int32)]
    width = 1
    while out[-1].max(initial=0) < n - 1:
        second = np.zeros(n, np.int64)
        second[: n - width] = out[-1][width:].astype(np.int64) + 1
        out.append(np.unique(out[-1].astype(np.int64) * (n + 1) + second, return_inverse=True)[1].astype(np.int32))
        width *= 2
    return out


class Extensions:
    """Lengths of the longest common prefixes of the suffixes of `items`."""

    def __init__(self, items: np.ndarray):
        ranks = _ranks(items)
        n = len(items)
        self.place = ranks[-1]  # of each suffix in the suffix array
        order = np.empty(n, np.int64)
        order[self.place] = np.arange(n)
        common = np.zeros(n, np.int32)  # of a suffix and the one before it in the array
        a, b = order[:-1].copy(), order[1:].copy()
        for k in range(len(ranks) - 1, -1, -1):
            width = 1 << k
            ok = (np.maximum(a, b) + width <= n).nonzero()[0]
            ok = ok[ranks[k][a[ok]] == ranks[k][b[ok]]]
            common[ok + 1] += width
            a[ok] += width
            b[ok] += width
        self.minima = [common]
        width = 1
        while 2 * width <= n:
            last = self.minima[-1]
            self.minima.append(np.minimum(last[: len(last) - width], last[width:]))
            width *= 2

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The common prefix of the suffixes at i and j (i != j)."""
        a, b = self.place[i], self.place[j]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.zeros(len(lo), np.int64)
        for k in np.unique(level):
            at = level == k
            row = self.minima[k]
            out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << k)])
        return out


def _grid(first: np.ndarray, size: np.ndarray, rules: RunRules) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place of jp, p) of all neighbours of all grids that can be in a run, periods from a power of two to the next
    together.  first: the places where texts begin; size: their words."""
    size = np.where(size < rules.least_length, 0, size)
    low = 1
    while 2 * low <= size.max(initial=0):
        who = np.flatnonzero(size >= 2 * low)
        p = np.arange(low, min(2 * low, int(size.max()) // 2 + 1))
        n = np.where(size[who][:, None] >= 2 * p, (size[who][:, None] - 1) // p, 0).ravel()
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        period = np.repeat(np.tile(p, len(who)), n)
        yield np.repeat(np.repeat(first[who], len(p)), n) + j * period, period
        low *= 2


def _laid(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words with a separator before each text and at the end, places where texts begin, their sizes)."""
    size = np.array([len(x) for x in texts], np.int64)
    begin = np.cumsum(size + 1) - size
    items = np.empty(int(size.sum()) + len(texts) + 1, np.int64)
    inside = np.ones(len(items), bool)
    inside[begin - 1] = inside[-1] = False
    items[inside] = np.concatenate(texts) if texts else 0
    items[~inside] = -1 - np.arange(len(texts) + 1)
    return items, begin, size


def find_runs(texts: list[np.ndarray], rules: RunRules = RunRules()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of every run of texts given as numbers of words, by text, start and period."""
    items, begin, size = _laid(texts)
    mixed = items.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    three = np.zeros(len(items) + 2, np.uint64)  # of three words, from two places before
    three[2 : len(items)] = mixed[:-2] + mixed[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + mixed[2:] * np.uint64(0xD1342543DE82EF95)
    held = []
    for at, p in _grid(begin, size, rules):
        some = (three[at] == three[at + p]) | (three[at + 2] == three[at + p + 2])
        held.append((at[some], p[some]))
    none = np.zeros(0, np.int64)
    at, p = (np.concatenate([x[k] for x in held] or [none]) for k in range(2))
    if not len(at):
        return none, none, none, none
    who = np.searchsorted(begin, at, "right") - 1
    some = np.unique(who)  # texts that need a suffix array
    items, new, _ = _laid([texts[k] for k in some])
    at = at - begin[who] + new[np.searchsorted(some, who)]
    n = len(items)
    forward = Extensions(items)(at, at + p)
    back = Extensions(items[::-1])(n - at, n - at - p)  # from the words before
    start, end = at - back, at + p + forward
    good = end - start >= np.maximum(rules.least_length, 2 * p)
    who, start, end, p = who[good], start[good], end[good], p[good]
    order = np.lexsort((p, end, start, who))  # a multiple of a period gives the same stretch: the least one counts
    who, start, end, p = who[order], start[order], end[order], p[order]
    once = np.ones(len(who), bool)
    once[1:] = (who[1:] != who[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    who, start, end, p = who[once], start[once], end[once], p[once]
    start, length = start - new[np.searchsorted(some, who)], end - start
    order = np.lexsort((p, start, who))
    return who[order], start[order], length[order], p[order]


def _numbered(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def summarize(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple:
    """(n_runs, start, length, period, exponent_milli, runs_sha256, kept words joined by a space) of a text's runs."""
    if not len(start):
        return 0, None, None, None, None, hashlib.sha256(b"").hexdigest(), b" ".join(words)
    best = np.lexsort((period, start, -length))[0]
    lines = "".join(f"{a},{n},{p}\n" for a, n, p in zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    gone = (np.cumsum(edge[:-1]) > 0).tolist()
    kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
    a, n, p = (int(x[best]) for x in (start, length, period))
    return len(start), a, n, p, 1000 * n // p, hashlib.sha256(lines.encode()).hexdigest(), kept


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: RunRules = RunRules(), details: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, (details) runs and
    collapsed_text, and the columns `carry` of every row of df.

    A run is a stretch with the smallest period q, of least_length and of 2q words at least, that can't be extended.
    start to exponent_milli are those of the longest run (of equal ones the first, then the one of the smaller period),
    null without runs.  collapsed_text keeps the words that no run holds after its first period, joined by a space.
    A null or empty text has no words and no run.  Rows are judged one by one, so repeated rows and rows without an id
    get their own results, and an empty table gives an empty one.  Texts are taken whole: a very long one is a step of
    its own, of some 400 bytes a word if it repeats.  A column in `carry` must not have the name of a result; other
    columns of df, whatever their names, aren't looked at.
    """
    kinds = dict(df.dtypes)
    rows = df.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"), *(F.col(f"`{c}`").alias(f"__c_{i}") for i, c in enumerate(carry)))

    def steps(texts: list[bytes]) -> Iterator[tuple[list[list[bytes]], list[np.ndarray]]]:
        words, codes, total, known = [], [], 0, {}
        for text in texts:
            own = text.split()  # of bytes: at runs of space and TAB..CR
            if total and total + len(own) > STEP_WORDS:
                yield words, codes
                words, codes, total, known = [], [], 0, {}
            words.append(own)
            codes.append(_numbered(own, known))
            total += len(own)
        if words:
            yield words, codes

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            blob, edges = data.tobytes(), offsets.tolist()
            out, runs, texts = [], [], []
            for words, codes in steps([blob[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]):
                who, start, length, period = find_runs(codes, rules)
                cut = np.searchsorted(who, np.arange(len(words) + 1))
                for own, a, b in zip(words, cut[:-1], cut[1:], strict=True):
                    *found, kept = summarize(own, start[a:b], length[a:b], period[a:b])
                    out.append((*found, hashlib.sha256(kept).hexdigest()))
                    if details:
                        runs.append([{"start": x, "length": y, "period": z} for x, y, z in zip(start[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist(), strict=True)])
                        texts.append(kept)
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.string()), pa.array(cols[6], pa.string())]
            names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
            if details:
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                arrays += [pa.array(runs, kind), pa.array(texts, pa.binary()).cast(pa.string())]
                names += ["runs", "collapsed_text"]
            yield pa.RecordBatch.from_arrays([*arrays, *(batch.column(2 + i) for i in range(len(carry)))], [*names, *carry])

    schema = f"doc_id {kinds[id_col]}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    schema += ", runs array<struct<start:long,length:long,period:long>>, collapsed_text string" * details + "".join(f", `{c}` {kinds[c]}" for c in carry)
    return rows.mapInArrow(lean(run), schema)


def with_planted_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with a repeat written into the words of a tenth of its texts, by a checksum of the id: from word a on, the p
    words at a again and again.  Other texts, and rows without an id or words, stay as they are."""
    h = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))
    words = F.array_remove(F.split(F.col(f"`{text_col}`"), "[\\x20\\x09-\\x0D]+"), "")
    x = F.col("__planted")

    def rewrite(x: Column) -> Column:
        n, g = F.size(x["w"]), x["g"]
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(x["w"], place(i))), " ")

    rows = df.withColumn("__planted", F.when(F.pmod(h, F.lit(10)) == 0, F.struct(F.floor(h / 10).alias("g"), words.alias("w"))))
    return rows.withColumn(text_col, F.when(F.size(x["w"]) > 0, rewrite(x)).otherwise(F.col(f"`{text_col}`"))).drop("__planted")
