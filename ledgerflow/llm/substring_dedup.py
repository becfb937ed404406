"""Substring dedup on word windows: words that an earlier document already has in a window are removed.

Method: each task sketches its window hashes; the merged count-min sketch overestimates counts, so windows it calls
single are single.  The second pass groups only the others, exactly (by 96 bits of two independent hashes of their
words' bytes).  Inside a slice of a task all but the smallest document of a window are settled at once.  Windows that
very many tasks have are dealt by document as well; the few smallest documents that come out of that are grouped once
more, by partial minima.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import sketch
from .bytekernels import lean, mix, text_buffer, valid_windows, window_hashes, word_bounds, word_hashes, word_slices
from .store import tidy, written

_MIDDLE = 1 << 31
#: Groups that a window of very many tasks is dealt to.
SALTS = 200


@dataclass(frozen=True)
class WindowRules:
    """window: consecutive words; bytes_a_word: only to size the sketch."""

    window: int = 13
    bytes_a_word: float = 6.0


def _windows(data: np.ndarray, offsets: np.ndarray, size: int, which: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, first word in its document) of every window of a slice."""
    starts, _, first = word_bounds(data, offsets)
    words = word_hashes(data, starts, which)
    at, doc = valid_windows(first, size, len(words))
    return window_hashes(words, size)[at], doc, at - first[:-1][doc]


def local_first(keys: tuple[np.ndarray, ...], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows with the smallest id of their key, in order of key; rows with a larger one)."""
    order = np.lexsort((ids, *keys))
    if not len(order):
        return order, order
    new = np.ones(len(order), bool)
    new[1:] = ~np.logical_and.reduce([k[order[1:]] == k[order[:-1]] for k in keys])
    later = ids[order] > ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    return order[~later], order[later]


def salts(hot: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """0 for rows that aren't hot, else 1 to SALTS by id."""
    return np.where(hot, 1 + (mix(ids.view(np.uint64)) % np.uint64(SALTS)).astype(np.int16), 0).astype(np.int16)


def _rows(h: np.ndarray, g: np.ndarray, salt: np.ndarray, doc: np.ndarray, tkey: np.ndarray, at: np.ndarray, settled: bool) -> pa.RecordBatch:
    """A row for each run of equal (h, g, doc, tkey): x has 32 bits of g and its first place p (-1 - p if settled) from
    _MIDDLE; `more` lists the other places, null if there are none."""
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1]) | (doc[1:] != doc[:-1]) | (tkey[1:] != tkey[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(h))) - 1
    rest = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(at[~new].astype(np.int32)), mask=pa.array(count == 0))
    place = (_MIDDLE + np.where(settled, -1 - at[first], at[first])).astype(np.uint64)
    x = (g[first] >> np.uint64(32) << np.uint64(32)) | place
    cols = [pa.array(h[first].view(np.int64)), pa.array(x.view(np.int64)), pa.array(salt[first]), pa.array(doc[first]), pa.array(tkey[first]), rest]
    return pa.RecordBatch.from_arrays(cols, ["h", "x", "s", "doc", "tkey", "more"])


def removed_starts(docs: DataFrame, rules: WindowRules = WindowRules()) -> DataFrame:
    """doc, tkey, at, more (further places or null): first words of the windows of docs (doc, tkey, text) that a document
    with a smaller id has too."""
    rows = docs.where("doc is not null").select("doc", "tkey", "text")

    def parts(batch):
        data, offsets = text_buffer(batch.column(2))
        for a, _, part, places, before in word_slices(data, offsets, rules.window):
            yield a, part, places, before

    def hashes_of(batch):
        for _, part, places, _ in parts(batch):
            yield _windows(part, places, rules.window)[0]

    shared, bits = sketch.build(rows, hashes_of, sketch.total_bytes(rows, "text") / rules.bytes_a_word, hot=True)
    tidy(rows.sparkSession)

    def second(batches):
        for batch in batches:
            ids, tkeys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, part, places, before in parts(batch):
                one, doc, at = _windows(part, places, rules.window)
                keep = sketch.repeated(shared.value[0], one, bits)
                if not keep.any():
                    continue
                one, two = one[keep], _windows(part, places, rules.window, 1)[0][keep]
                own, key, at = ids[doc[keep] + a], tkeys[doc[keep] + a], at[keep] + before
                open_, later = local_first((one, two), own)
                if len(open_):
                    salt = salts(sketch.frequent(shared.value[1], one[open_], bits), own[open_])
                    yield _rows(one[open_], two[open_], salt, own[open_], key[open_], at[open_], False)
                if len(later):  # settled: one row for each document, in a group of its own
                    later = later[np.lexsort((at[later], key[later], own[later]))]
                    h = row_hashes(own[later], key[later])
                    yield _rows(h, h, np.zeros(len(h), np.int16), own[later], key[later], at[later], True)

    found = rows.mapInArrow(lean(second), "h long, x long, s short, doc long, tkey long, more array<int>").repartition("h", "s")
    at = F.col("x").bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(_MIDDLE)
    found = found.select("h", F.shiftright("x", 32).alias("g"), "s", at.cast("int").alias("at"), "doc", "tkey", "more")
    least = F.min(F.when(F.col("at") >= 0, F.col("doc"))).over(Window.partitionBy("h", "g", "s"))
    gone = (F.col("at") < 0) | (F.col("doc") > least)
    found = found.withColumn("gone", gone).where("gone or s > 0")
    place = F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at"))
    found = written(found.select(*(F.when(~F.col("gone"), F.col(c)).alias(c) for c in ("h", "g")), "doc", "tkey", place.alias("at"), "more"), "window-rows")
    shared.destroy()  # what it was for is a written table
    tidy(rows.sparkSession)
    # the smallest documents of each salt: a few for a window, met by partial minima
    open_ = found.where("h is not null")
    met = open_.join(open_.groupBy("h", "g").agg(F.min("doc").alias("least")), ["h", "g"]).where("doc > least")
    return found.where("h is null").select("doc", "tkey", "at", "more").unionByName(met.select("doc", "tkey", "at", "more"))


def row_hashes(ids: np.ndarray, tkeys: np.ndarray) -> np.ndarray:
    return mix(ids.view(np.uint64) ^ mix(tkeys.view(np.uint64)))


def split_touched(docs: DataFrame, touched: DataFrame) -> tuple[DataFrame, Callable]:
    """(rows of docs that may be in touched (doc, tkey), a filter of batches of docs for rows that surely aren't).

    A sketch of fixed size decides, so that only texts that change are shuffled to their changes.  Rows without an id
    aren't in touched.
    """

    def hashes_of(batch):
        h = row_hashes(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield h
        yield h  # two hits set a cell

    shared, bits = sketch.build(touched.select("doc", "tkey"), hashes_of, 2 * touched.count())

    def pick(batch: pa.RecordBatch, want: bool) -> pa.RecordBatch:
        hit = sketch.repeated(shared.value, row_hashes(batch.column(0).fill_null(0).to_numpy(), batch.column(1).to_numpy()), bits)
        hit &= batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        return batch.filter(pa.array(hit == want))

    return docs.mapInArrow(lean(lambda batches: (pick(b, True) for b in batches)), docs.schema), lambda batches: (pick(b, False) for b in batches)


def keyed_texts(df: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc, tkey, text (and __c_0, ... for the columns `carry`): tkey tells rows with one id but different texts apart; it is 0 where ids don't repeat, which
    one count of ids decides, so that the many rows that carry it compress."""
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"), *(F.col(f"`{c}`").alias(f"__c_{i}") for i, c in enumerate(carry)))
    alone = docs.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1 and doc is not null").isEmpty()
    return docs.select("doc", (F.lit(0).cast("long") if alone else F.xxhash64("text")).alias("tkey"), "text", *(f"__c_{i}" for i in range(len(carry))))


def kept_text(text: bytes, starts: np.ndarray, size: int) -> tuple[int, int, bytes]:
    """(words, removed words, kept words joined by a space)."""
    words = text.split()  # of bytes: at runs of space and TAB..CR
    if not len(starts):
        return len(words), 0, b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.unique(starts)
    edge[starts] += 1
    edge[starts + size] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: WindowRules = WindowRules(), keep_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, (keep_text) kept_text and the columns `carry` of every row of df.

    A null or empty text has no words and nothing is removed; a row without an id takes no part and stays whole.
    Repeated rows and other ties (rows of one id) are never "smaller" than each other: each loses what smaller ids have.
    Texts are taken whole, very long ones in parts that overlap by a window less a word; an empty table gives an empty
    one.  A column in `carry` must not have the name of a result; other columns of df, whatever their names, aren't looked at.
    """
    docs = keyed_texts(df, id_col, text_col, carry)
    starts = removed_starts(docs, rules)
    size = rules.window

    def finish(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            blob, out = data.tobytes(), []
            one, more = batch.column(2), batch.column(3)
            edges = offsets.tolist()
            for i in range(batch.num_rows):
                at = np.concatenate([one[i].values.to_numpy(), more[i].values.flatten().to_numpy()]) if one[i].is_valid else np.zeros(0, np.int32)
                n, gone, text = kept_text(blob[edges[i] : edges[i + 1]], at, size)
                out.append((n, gone, hashlib.sha256(text).hexdigest(), text if keep_text else b""))
            cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            arrays = [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())]
            if keep_text:
                arrays.append(pa.array(cols[3], pa.binary()).cast(pa.string()))
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: len(arrays)]
            yield pa.RecordBatch.from_arrays([*arrays, *(batch.column(4 + i) for i in range(len(carry)))], [*names, *carry])

    kinds = dict(df.dtypes)
    lists = written(starts.groupBy("doc", "tkey").agg(F.collect_set("at").alias("one"), F.collect_set("more").alias("more")), "removed-starts")  # words of one text, however often it is there
    tidy(df.sparkSession)
    hit, rest = split_touched(docs, lists)
    carried = [f"__c_{i}" for i in range(len(carry))]
    joined = hit.join(lists, ["doc", "tkey"], "left").select("doc", "text", "one", "more", *carried)

    def whole(batches):
        for b in rest(batches):
            none = [pa.nulls(b.num_rows, pa.list_(pa.int32())), pa.nulls(b.num_rows, pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *none, *(b.column(3 + i) for i in range(len(carry)))], ["doc", "text", "one", "more", *carried])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text + "".join(f", `{c}` {kinds[c]}" for c in carry)
    return joined.mapInArrow(lean(finish), schema).unionByName(docs.mapInArrow(lean(lambda batches: finish(whole(batches))), schema))
