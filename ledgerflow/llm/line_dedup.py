"""Line dedup: a line that an earlier document already has is removed.

Method: two Bloom filters, for hashes seen once and seen twice.  Each task sets the cells of its line hashes in the once
filter, or in the twice filter if they are set already; ranges of cells are merged (a cell that two tasks have once is a
cell of twice), so a line of two documents always passes the merged twice filter.  Only such suspected lines are
shuffled, by 128 bits of hash, to be confirmed exactly and to find the smallest document that holds them.  Inside a batch
all but the smallest document of a line are settled at once; lines of very many tasks are dealt by document as well, and
the few smallest documents that come out of that are met once more by partial minima.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import sketch
from .bytekernels import lean, text_buffer
from .store import tidy, written
from .substring_dedup import local_first, row_hashes, salts, split_touched

#: White space that keys are stripped of.
SPACES = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class LineKeys:
    """least_chars: code points of the shortest key that counts."""

    least_chars: int = 10


def line_key(line: bytes, rules: LineKeys = LineKeys()) -> bytes | None:
    """The line without white space at its ends, A-Z in lower case; None if that is too short to count."""
    key = line.strip(SPACES).lower()  # of bytes: A-Z alone
    n = len(key)
    if n < rules.least_chars or (n < 4 * rules.least_chars and len(key.decode("utf-8", "replace")) < rules.least_chars):
        return None
    return key


def _hashes(keys: list[bytes]) -> np.ndarray:
    """(n, 2) uint64: 128 bits of each key."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<u8").reshape(-1, 2)


def _texts(column: pa.Array) -> Iterator[bytes]:
    data, offsets = text_buffer(column)
    blob = data.tobytes()
    edges = offsets.tolist()
    return (blob[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True))


def _document_keys(column: pa.Array, rules: LineKeys) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the different keys of each text, row of each)."""
    keys, counts = [], []
    for text in _texts(column):
        own = {line_key(x, rules) for x in text.split(b"\n")}
        own.discard(None)
        keys += own
        counts.append(len(own))
    return _hashes(keys), np.repeat(np.arange(len(counts)), counts)


def repeated_lines(docs: DataFrame, rules: LineKeys = LineKeys()) -> DataFrame:
    """doc, g (64 bits of the key): each line of docs (doc, text) that a document with a smaller id has too."""
    rows = docs.where("doc is not null").select("doc", "text")
    # no more keys than lines
    lines = rows.agg(F.sum(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0]
    twice, bits = sketch.build(rows, lambda b: [_document_keys(b.column(1), rules)[0][:, 0]], float(lines or 0), hot=True)
    tidy(rows.sparkSession)

    def suspects(batches):
        for batch in batches:
            both, row = _document_keys(batch.column(1), rules)
            keep = sketch.repeated(twice.value[0], both[:, 0], bits)
            if not keep.any():
                continue
            one, two, own = both[keep, 0], both[keep, 1], batch.column(0).to_numpy()[row[keep]]
            open_, later = local_first((one, two), own)
            salt = salts(sketch.frequent(twice.value[1], one[open_], bits), own[open_])
            spread = row_hashes(own[later], two[later].view(np.int64))  # settled: groups of their own
            cols = [np.concatenate([one[open_], spread]).view(np.int64), np.concatenate([two[open_], two[later]]).view(np.int64), np.concatenate([salt, np.zeros(len(later), np.int16)]), np.concatenate([own[open_], own[later]]), np.arange(len(own)) >= len(open_)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h", "g", "s", "doc", "settled"])

    found = rows.mapInArrow(lean(suspects), "h long, g long, s short, doc long, settled boolean").repartition("h", "s")
    least = F.min(F.when(~F.col("settled"), F.col("doc"))).over(Window.partitionBy("h", "g", "s"))
    found = found.withColumn("gone", F.col("settled") | (F.col("doc") > least)).where("gone or s > 0")
    found = written(found.select(F.when(~F.col("gone"), F.col("h")).alias("h"), "g", "doc"), "line-rows")
    twice.destroy()  # what it was for is a written table
    tidy(rows.sparkSession)
    # the smallest documents of each salt: a few for a line, met by partial minima
    open_ = found.where("h is not null")
    met = open_.join(open_.groupBy("h", "g").agg(F.min("doc").alias("least")), ["h", "g"]).where("doc > least")
    return found.where("h is null").select("doc", "g").unionByName(met.select("doc", "g"))


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineKeys = LineKeys(), keep_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256, (keep_text) kept_text and the columns `carry` of every row of df.

    Lines are parted at \\n; a null or empty text is one empty line and loses nothing.  A key of least_chars or more that
    a smaller doc_id holds too loses all its lines in a document, those of the smallest one stay.  A row without an id
    takes no part and stays whole.  Repeated rows and other ties (rows of one id) are never "smaller" than each other:
    each keeps or loses the same lines.  Texts are taken whole (a row must fit a task); an empty table gives an empty one.
    A column in `carry` must not have the name of a result; other columns of df, whatever their names, aren't looked at.
    """
    kinds = dict(df.dtypes)
    carried = [f"__c_{i}" for i in range(len(carry))]
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.lit(0).cast("long").alias("tkey"), F.col(f"`{text_col}`").cast("string").alias("text"), *(F.col(f"`{c}`").alias(k) for c, k in zip(carry, carried, strict=True)))
    lists = written(repeated_lines(docs, rules).groupBy("doc").agg(F.collect_set("g").alias("gone")).withColumn("tkey", F.lit(0).cast("long")), "repeated-lines")
    tidy(df.sparkSession)
    hit, rest = split_touched(docs, lists)
    joined = hit.join(lists.drop("tkey"), "doc", "left").select("doc", "text", "gone", *carried)

    def judged(batches):
        for batch in batches:
            out = []
            for text, list_ in zip(_texts(batch.column(1)), batch.column(2), strict=True):
                lines = text.split(b"\n")
                kept = lines
                if list_.is_valid:
                    keys = [line_key(x, rules) for x in lines]
                    gone = np.isin(_hashes([k or b"" for k in keys])[:, 1].view(np.int64), list_.values.to_numpy()) & np.array([k is not None for k in keys])
                    kept = [x for x, g in zip(lines, gone.tolist(), strict=True) if not g]
                whole = b"\n".join(kept)
                out.append((len(lines), len(lines) - len(kept), hashlib.sha256(whole).hexdigest(), whole if keep_text else b""))
            cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            arrays = [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())]
            if keep_text:
                arrays.append(pa.array(cols[3], pa.binary()).cast(pa.string()))
            names = ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text"][: len(arrays)]
            yield pa.RecordBatch.from_arrays([*arrays, *(batch.column(3 + i) for i in range(len(carry)))], [*names, *carry])

    def untouched(batches):
        for b in rest(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.nulls(b.num_rows, pa.list_(pa.int64())), *(b.column(3 + i) for i in range(len(carry)))], ["doc", "text", "gone", *carried])

    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * keep_text + "".join(f", `{c}` {kinds[c]}" for c in carry)
    return joined.mapInArrow(lean(judged), schema).unionByName(docs.mapInArrow(lean(lambda batches: judged(untouched(batches))), schema))
