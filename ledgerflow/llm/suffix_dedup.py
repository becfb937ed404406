"""Byte-substring dedup by a depth-limited radix sort of suffixes.

Only the first `length` bytes of a suffix count.  Suffixes are dealt by digits, most significant first, in passes, each
of which goes on with what the pass before couldn't finish:

1. The first digit of a suffix is the least `gram`-byte string (by hash) in its first `length` bytes, not its first
   bytes: neighbouring suffixes then share it, so a run of them moves as one row.  One row a byte position would be many
   times the input.  A histogram of digits (merged over all tasks) finishes suffixes whose digit occurs once.
2. Runs are grouped by digit and content.  In a group of equal runs all but the smallest document are finished: each of
   their suffixes is repeated.  Smallest documents go on only if their first digit has other runs too.
3. The suffixes of the runs that are left go on one by one.  A histogram of their first `length` bytes finishes those
   that occur once.  The others are sorted by their bytes, in digits of eight, the first three of which also deal them
   to tasks: equal neighbours of that order are exactly the repeated strings.  Equal suffixes have one first digit, so
   this pass takes one share of the first digits after the other: what it holds on disk and in its histogram at a time
   doesn't grow with the corpus.

Runs are told apart by 128 bits (64 of the digit, 64 of the content); suffixes by their bytes.  What very many tasks
hold is dealt by document as well, and the smallest documents that come out are met once more, by partial minima.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import sketch
from .bytekernels import byte_slices, byte_windows, lean, mix, sliding_min, text_buffer
from .store import drop, tidy, written
from .substring_dedup import keyed_texts, local_first, row_hashes, salts, split_touched

_PLACE_BITS = 30
#: Bytes of contested runs that one batch of their table holds at most.
BLOCK_BYTES = 1 << 24
#: Shares of the first digits, and suffixes that the third pass takes at a time, about.
SHARES, TOGETHER = 256, 1 << 26
#: Runs of a task of the second pass, about.
TASK_RUNS = 2_000_000


@dataclass(frozen=True)
class SuffixRules:
    """length: threshold in bytes; gram: bytes of the first digit."""

    length: int = 50
    gram: int = 24


def runs(data: np.ndarray, offsets: np.ndarray, rules: SuffixRules) -> tuple[np.ndarray, ...]:
    """(first digit, run hash, document, first byte in the document, number of suffixes) of each run of a slice."""
    n = len(data) - rules.length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    hashes = byte_windows(data, (rules.gram, rules.length))
    digit = mix(hashes[rules.gram])
    keyed = (digit >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(len(digit), dtype=np.uint64)
    at = (sliding_min(keyed, rules.length - rules.gram + 1)[:n] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    whole = np.arange(n) + rules.length <= offsets[1:][doc]
    new = np.ones(n, bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new & whole)
    if not len(first):
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    count = np.bincount(np.cumsum(new & whole)[whole] - 1, minlength=len(first))
    content = np.add.reduceat(np.where(whole, mix(hashes[rules.length]), np.uint64(0)), first)
    return digit[at[first]], mix(content + count.astype(np.uint64)), doc[first], first - offsets[:-1][doc[first]], count


def _second_pass(rows: DataFrame, rules: SuffixRules) -> DataFrame:
    """doc, tkey, at, n, contested, share: runs that a smaller document has whole, and contested ones, which may share
    suffixes; share: that of the first digit (null if not contested)."""

    def parts(batch):
        data, offsets = text_buffer(batch.column(2))
        for a, _, part, places, before in byte_slices(data, offsets, rules.length):
            yield a, before, runs(part, places, rules)

    expected = sketch.total_bytes(rows, "text") * 2 / (rules.length - rules.gram + 2)
    shared, bits = sketch.build(rows, lambda batch: (r[0] for _, _, r in parts(batch)), 2 * expected, hot=True)
    tidy(rows.sparkSession)

    def second(batches):
        for batch in batches:
            ids, tkeys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, before, found in parts(batch):
                keep = sketch.repeated(shared.value[0], found[0], bits)
                digit, run, doc, at, n = (x[keep] for x in found)
                hot = sketch.frequent(shared.value[1], digit, bits)
                key = np.where(hot, mix(digit ^ mix(run)), digit)
                open_, later = local_first((digit, run), ids[doc + a])
                if len(open_):
                    row = doc[open_] + a
                    share = np.where(hot[open_], digit[open_] % np.uint64(SHARES), 0).astype(np.int16)  # else the key has it
                    cols = [key[open_].view(np.int64), run[open_].view(np.int64), ids[row], tkeys[row], (at[open_] + before).astype(np.int32), n[open_].astype(np.int32), salts(hot[open_], ids[row]), share]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)
                if len(later):  # settled: they only pass through, neighbours of a document as one row
                    later = later[np.lexsort((at[later], doc[later]))]
                    new = np.ones(len(later), bool)
                    new[1:] = (doc[later[1:]] != doc[later[:-1]]) | (at[later[1:]] != at[later[:-1]] + n[later[:-1]])
                    first = np.flatnonzero(new)
                    row, many = doc[later[first]] + a, np.add.reduceat(n[later], first)
                    none = np.zeros(len(first), np.int16)
                    cols = [row_hashes(ids[row], tkeys[row]).view(np.int64), none.astype(np.int64), ids[row], tkeys[row], (at[later[first]] + before).astype(np.int32), many.astype(np.int32), none - np.int16(1), none]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    names = ["key", "run", "doc", "tkey", "at", "n", "s", "share"]
    # tasks grow with the runs, so that a task's share is sorted in memory
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(expected / TASK_RUNS))
    found = rows.mapInArrow(lean(second), "key long, run long, doc long, tkey long, at int, n int, s short, share short").repartition(tasks, "key", "s")
    same, digit = Window.partitionBy("key", "s", "run"), Window.partitionBy("key", "s")
    found = found.withColumn("least", F.min(F.when(F.col("s") >= 0, F.col("doc"))).over(same)).withColumn("low", F.min("run").over(digit)).withColumn("high", F.max("run").over(digit))
    gone = (F.col("s") < 0) | (F.col("doc") > F.col("least"))
    contested = ~gone & ((F.col("s") > 0) | (F.col("low") != F.col("high")))
    share = F.when(F.col("s") > 0, F.col("share")).otherwise(F.col("key").bitwiseAND(F.lit(SHARES - 1))).cast("short")
    return found.where(gone | contested).select("doc", "tkey", "at", "n", (~gone).alias("contested"), F.when(~gone, share).alias("share"))


def _lists(runs_: DataFrame, *more: str) -> DataFrame:
    """doc, tkey and at, n (and columns `more`) of its runs as lists: of one text, however often it is there."""
    sets = runs_.groupBy("doc", "tkey").agg(F.collect_set(F.struct("at", "n", *more)).alias("r"))
    return sets.select("doc", "tkey", *(F.col(f"r.{c}").alias(c) for c in ("at", "n", *more)))


def _contested_runs(docs: DataFrame, contested: DataFrame, rules: SuffixRules) -> DataFrame:
    """doc, tkey, at, content, share of contested runs."""
    lists = written(_lists(contested, "share"), "contested")

    def contents(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            every = batch.column(3).flatten().to_numpy()
            sizes = batch.column(4).flatten().to_numpy().astype(np.int64) + rules.length - 1
            shares = batch.column(5).flatten()
            rows = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(3).offsets.to_numpy()))
            until = np.cumsum(sizes)
            begin = 0
            while begin < len(sizes):
                end = max(begin + 1, int(np.searchsorted(until, (until[begin - 1] if begin else 0) + BLOCK_BYTES, "right")))
                at, size, row = every[begin:end], sizes[begin:end], rows[begin:end]
                ends = np.concatenate([[0], np.cumsum(size)])
                flat = data[np.repeat(offsets[:-1][row] + at - ends[:-1], size) + np.arange(ends[-1])]
                text = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])
                pick = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array(at), text, shares.slice(begin, end - begin)], ["doc", "tkey", "at", "content", "share"])
                begin = end

    hit, _ = split_touched(docs, lists)
    joined = hit.join(lists, ["doc", "tkey"]).select("doc", "tkey", "text", "at", "n", "share")
    pieces = written(joined.mapInArrow(lean(contents), "doc long, tkey long, at int, content binary, share short"), "contested-runs")
    drop(lists)
    tidy(docs.sparkSession)
    return pieces


def byte_digits(data: np.ndarray, at: np.ndarray, length: int) -> list[np.ndarray]:
    """The `length` bytes from each place as int64 digits of eight bytes (the last of what is left, then zeros), so
    that the order of digits is the order of bytes."""
    out = []
    for first in range(0, length, 8):
        digit = np.zeros(len(at), np.uint64)
        for k in range(8):
            digit <<= np.uint64(8)
            if first + k < length:
                digit |= data[at + (first + k)].astype(np.uint64)
        out.append((digit ^ np.uint64(1 << 63)).view(np.int64))
    return out


def _third_pass(pieces: DataFrame, rules: SuffixRules) -> list[DataFrame]:
    """Written tables doc, tkey, at, n: _sorted_suffixes() of pieces (contested runs), one range of shares after the other."""
    each = (rules.length - rules.gram + 1) / 2  # suffixes of a run
    ranges = int(np.clip(np.ceil(each * pieces.count() / TOGETHER), 1, SHARES))
    edges = np.linspace(0, SHARES, ranges + 1).astype(int).tolist()
    return [_sorted_suffixes(pieces.where(F.col("share").between(a, b - 1)).drop("share"), rules) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _sorted_suffixes(pieces: DataFrame, rules: SuffixRules) -> DataFrame:
    """The written table doc, tkey, at, n of runs of suffixes of pieces that a smaller document has too."""
    digits = [f"d{i}" for i in range(-(-rules.length // 8))]

    def parts(batch):
        data, offsets = text_buffer(batch.column(3))
        for a, _, part, places, before in byte_slices(data, offsets, rules.length):
            n = len(part) - rules.length + 1
            if n > 0:
                row = np.repeat(np.arange(len(places) - 1), np.diff(places))[:n]
                whole = np.flatnonzero(np.arange(n) + rules.length <= places[1:][row])
                yield a + row[whole], whole, before + whole - places[:-1][row[whole]], part, mix(byte_windows(part, (rules.length,))[rules.length][whole])

    expected = (rules.length - rules.gram + 1) / 2 * pieces.count()
    shared, bits = sketch.build(pieces, lambda batch: (p[4] for p in parts(batch)), expected, hot=True)
    tidy(pieces.sparkSession)

    def deal(batches):
        for batch in batches:
            ids, tkeys, begin = (batch.column(k).to_numpy() for k in range(3))
            for row, place, at, part, h in parts(batch):
                keep = sketch.repeated(shared.value[0], h, bits)
                if not keep.any():
                    continue
                row, at, h = row[keep], (begin[row[keep]] + at[keep]).astype(np.int32), h[keep]
                own, key, d = ids[row], tkeys[row], byte_digits(part, place[keep], rules.length)
                open_, later = local_first(tuple(d), own)
                if len(open_):
                    salt = salts(sketch.frequent(shared.value[1], h[open_], bits), own[open_])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*(x[open_] for x in d), salt, own[open_], key[open_], at[open_], np.ones(len(open_), np.int32))], names)
                if len(later):  # settled: they only pass through, a row for each run of places
                    later = later[np.lexsort((at[later], key[later], own[later]))]
                    new = np.ones(len(later), bool)
                    new[1:] = (own[later[1:]] != own[later[:-1]]) | (key[later[1:]] != key[later[:-1]]) | (at[later[1:]] != at[later[:-1]] + 1)
                    n = np.diff(np.append(np.flatnonzero(new), len(later))).astype(np.int32)
                    later = later[new]
                    none, through = np.zeros(len(later), np.int64), row_hashes(own[later], key[later]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (through, *[none] * (len(d) - 1), np.full(len(later), -1, np.int16), own[later], key[later], at[later], n)], names)

    names = [*digits, "s", "doc", "tkey", "at", "n"]

    def meet(batches):
        """Of sorted rows: those whose equal neighbours begin with a smaller document, and (open) the first of salted ones."""
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy() for c in batch.columns]
            keys, salt, doc = cols[: len(digits) + 1], cols[len(digits)], cols[len(digits) + 1]
            new = np.ones(batch.num_rows, bool)
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
            new[0] = before is None or any(k[0] != b for k, b in zip(keys, before[0], strict=True))
            group = np.cumsum(new)
            firsts = np.concatenate([[before[1] if before else 0], doc[new]])
            gone = (salt < 0) | (doc > firsts[group])
            before = ([k[-1] for k in keys], firsts[group[-1]])
            use = pa.array(np.flatnonzero(gone | (salt > 0)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(use) for k in range(len(digits))), pa.array(~gone[gone | (salt > 0)]), *(batch.column(len(digits) + k).take(use) for k in (1, 2, 3, 4))], [*digits, "open", "doc", "tkey", "at", "n"])

    schema = ", ".join(f"{d} long" for d in digits)
    found = pieces.mapInArrow(lean(deal), f"{schema}, s short, doc long, tkey long, at int, n int").repartition(*digits[:3], "s").sortWithinPartitions(*digits, "s", "doc")
    met = written(found.mapInArrow(lean(meet), f"{schema}, open boolean, doc long, tkey long, at int, n int"), "suffix-rows")
    shared.destroy()  # what it was for is a written table
    tidy(pieces.sparkSession)
    open_ = met.where("open")
    late = open_.join(open_.groupBy(*digits).agg(F.min("doc").alias("least")), digits).where("doc > least")
    out = written(met.where("not open").select("doc", "tkey", "at", "n").unionByName(late.select("doc", "tkey", "at", "n")), "third-pass")
    drop(met)
    tidy(pieces.sparkSession)
    return out


def removed_mask(size: int, at: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """True for bytes that a suffix of runs (at, n) covers."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n + length - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: SuffixRules = SuffixRules(), keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (keep_bytes) spans (array of first byte and end), kept.

    A null text is empty.  A row without an id takes no part and stays whole; rows with one id (repeated rows and other
    ties) are never "smaller" than each other.  Strings are those of whole texts as UTF-8 and never cross documents; very
    long texts are taken in parts that overlap by length - 1 bytes.  An empty table gives an empty one.  Other columns of
    df, whatever their names, aren't looked at.
    """
    docs = keyed_texts(df, id_col, text_col)
    some = docs.where("doc is not null")
    passed = written(_second_pass(some, rules), "second-pass")
    tidy(df.sparkSession)
    pieces = _contested_runs(some, passed.where("contested").select("doc", "tkey", "at", "n", "share"), rules)
    late = _third_pass(pieces, rules)
    drop(pieces)
    every = reduce(DataFrame.unionByName, [passed.where("not contested").select("doc", "tkey", "at", "n"), *late])
    lists = written(_lists(every), "removed-runs")
    drop(passed, *late)
    tidy(df.sparkSession)
    hit, rest = split_touched(docs, lists)
    joined = hit.join(lists, ["doc", "tkey"], "left").select("doc", "text", "at", "n")

    def whole(batches):
        for b in rest(batches):
            none = pa.nulls(b.num_rows, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), none, none], ["doc", "text", "at", "n"])

    def finish(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            places, counts = batch.column(2), batch.column(3)
            edges, out = offsets.tolist(), []
            for i in range(batch.num_rows):
                text = data[edges[i] : edges[i + 1]]
                spans = []
                if places[i].is_valid:
                    gone = removed_mask(len(text), places[i].values.to_numpy(), counts[i].values.to_numpy(), rules.length)
                    turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    spans = turns.reshape(-1, 2).tolist()
                    text = text[~gone]
                raw = text.tobytes()
                out.append((edges[i + 1] - edges[i], edges[i + 1] - edges[i] - len(raw), len(spans), hashlib.sha256(raw).hexdigest(), [{"first": a, "end": b} for a, b in spans] if keep_bytes else None, raw if keep_bytes else None))
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])), pa.binary()][: 6 if keep_bytes else 4]
            arrays = [batch.column(0), *(pa.array(list(c), t) for c, t in zip(cols, kinds, strict=False))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"][: len(arrays)])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<struct<first:long,end:long>>, kept binary" * keep_bytes
    return joined.mapInArrow(lean(finish), schema).unionByName(docs.mapInArrow(lean(lambda batches: finish(whole(batches))), schema))
