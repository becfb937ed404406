"""Exact Jaccard join of documents on word n-grams, by vertical partitioning.

The global order of n-grams is that of their 64-bit hashes, cut into fragments of equal width, so the n-grams of a
document fall into the fragments evenly.  For documents of one range of sizes, so many fragments are cut that two that
link must agree wholly in at least one (their sets differ in at most D n-grams; there are D + 1 fragments, and some for
empty ones).  Fragments that agree give candidates.  A pair's overlap is counted fragment by fragment, each partial
count by itself, and summed; the sum decides exactly.

Copies (equal sets) are one node from the start, and only one text of each node is looked at after that.  There are
some more fragments than that argument needs, so two documents that link agree in several; each document then leaves
out as many of its most frequent fragments, and the rarest one that two of them agree in always stays.  So a passage
that very many documents share makes no candidates, unless they have little else.

In a group of near copies not every pair is made: each fragment's most connected node is compared with the others
first, links are contracted to components, and only pairs whose components still differ are compared after that.  A
pair in one component can't change any component.  Before the overlap of a pair is counted, parity maps of 512 bits
rule out pairs that differ in too many n-grams.

Links are counted after that, all of them: a link never leaves its component, so the sets of each component are cut
into blocks, and every two blocks are compared whole in one task, which gives counts and no row for a pair.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sketch
from .bytekernels import ASCII_LOWER, lean, mix, slices, text_buffer, valid_windows, window_hashes, word_bounds, word_hashes, word_slices
from .components import components
from .store import drop, tidy, written


@dataclass(frozen=True)
class JoinRules:
    """words: n of the n-grams; percent: least Jaccard similarity; parts: vertical partitions that overlaps are counted in;
    block_rows, block_tokens: mean size of a block of a large component."""

    words: int = 3
    percent: int = 90
    parts: int = 4
    pivot_rounds: int = 2
    block_rows: int = 1024
    block_tokens: int = 1 << 20


@lru_cache(maxsize=8)
def size_ranges(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first size of each range, fragments, empty fragments that need no row, fragments that a document may leave out)
    for sizes up to 2**31.

    Two sizes that can link lie in one range or in neighbours; instance i joins ranges i - 1 and i.  Sets that link differ
    in at most D fragments of D + 1 + more + k, so they agree in 1 + more that aren't empty, if they have k empty ones at most.
    """
    first = [1]
    while first[-1] < 2**31:
        first.append(max(first[-1] + 1, (first[-1] - 1) * 100 // percent + 1))
    first = np.array(first, np.int64)
    cuts, spare, extra = [], [], []
    for i in range(len(first) - 1):
        differ = int(2 * (first[i + 1] - 1) * (100 - percent) // (100 + percent))
        least = max(1, int(first[max(0, i - 1)]))
        more, k = differ // 6, 0
        for _ in range(8 if differ else 0):
            empty = (n := differ + 1 + more + k) * np.exp(-least / n)
            k = int(np.ceil(empty + 3 * empty**0.5)) + 1
        cuts.append(differ + 1 + more + k)
        spare.append(k)
        extra.append(more)
    return first, np.array(cuts, np.int64), np.array(spare, np.int64), np.array(extra, np.int64)


def _distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def ngram_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, documents): the distinct n-grams of each document in the global order, ASCII letters lower-cased.

    A document with fewer words has its whole sequence as its one n-gram.  A very long one is taken in parts.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for row, _, part, places, before in word_slices(data, offsets, words):
        part = ASCII_LOWER[part]
        starts, _, first = word_bounds(part, places)
        w = word_hashes(part, starts)
        at, doc = valid_windows(first, words, len(w))
        h = window_hashes(w, words)[at]
        count = np.diff(first)
        for d in np.flatnonzero((count > 0) & (count < words) & (before == 0)):
            whole = mix(window_hashes(w[first[d] : first[d + 1]], int(count[d])) + np.uint64(count[d]))
            h, doc = np.append(h, whole), np.append(doc, d)
        found.append(_distinct(h, doc + row))
    if len(found) == 1:
        return found[0]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return _distinct(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))


def _fragment(h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return (((h >> np.uint64(32)) * cuts.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)


def set_hashes(h: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, set hashes; 0 for the empty set) of the documents of a slice."""
    size = np.bincount(doc, minlength=n_docs)
    node = np.zeros(n_docs, np.uint64)
    if len(h):
        full = np.flatnonzero(size)
        begin = (np.cumsum(size) - size)[full]
        node[full] = mix(np.add.reduceat(mix(h ^ np.uint64(0x7FB5D329728EA185)), begin) + size[full].astype(np.uint64))
    return size, node


def signatures(h: np.ndarray, doc: np.ndarray, n_docs: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature hashes, their documents, their instances) of the documents of a slice."""
    size = np.bincount(doc, minlength=n_docs)
    spread = mix(h ^ np.uint64(0x7FB5D329728EA185))
    first, cuts, spare, _ = size_ranges(percent)
    own = np.searchsorted(first, size, "right") - 1
    keys, docs, insts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for up in (0, 1):
        inst = own + up
        fragment = _fragment(h, cuts[inst][doc])
        new = np.ones(len(h), bool)
        new[1:] = (fragment[1:] != fragment[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        if not len(at):
            continue
        place = (inst[doc[at]].astype(np.uint64) << np.uint64(40)) | fragment[at].astype(np.uint64)
        keys.append(mix(np.add.reduceat(spread, at) ^ mix(place)))
        docs.append(doc[at])
        empty = cuts[inst] - np.bincount(doc[at], minlength=n_docs)
        for d in np.flatnonzero((empty > spare[inst]) & (size > 0)):  # rare: its empty fragments count too
            none = np.setdiff1d(np.arange(cuts[inst[d]]), fragment[at][doc[at] == d])
            keys.append(mix(mix((np.uint64(inst[d]) << np.uint64(40)) | none.astype(np.uint64)) + np.uint64(1)))
            docs.append(np.full(len(none), d))
        insts += [inst[d] for d in docs[len(insts) :]]
    return np.concatenate(keys), np.concatenate(docs), np.concatenate(insts)


#: 64-bit words of a parity map: each n-gram turns one bit, so two maps differ in at most as many bits as the sets do in
#: n-grams.  For large sets the bound is loose, never wrong.
PARITY = tuple(f"p{i}" for i in range(8))


def parity_maps(h: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """(documents x 8) uint64 parity maps."""
    out = np.zeros((n_docs, len(PARITY)), np.uint64)
    if len(h):
        size = np.bincount(doc, minlength=n_docs)
        full = np.flatnonzero(size)
        bit = (mix(h ^ np.uint64(0x3C79AC492BA7B653)) & np.uint64(64 * len(PARITY) - 1)).astype(np.int64)
        one = np.zeros((len(h), len(PARITY)), np.uint64)
        one[np.arange(len(h)), bit >> 6] = np.uint64(1) << (bit & 63).astype(np.uint64)
        out[full] = np.bitwise_xor.reduceat(one, (np.cumsum(size) - size)[full], axis=0)
    return out


def _near_enough(a: str, b: str, na: str, nb: str, percent: int) -> Column:
    """False only if the parity maps a_p0.. and b_p0.. prove that the sets differ in too many n-grams."""
    apart = sum((F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in PARITY), F.lit(0))
    return apart * (100 + percent) <= (F.col(na) + F.col(nb)) * (100 - percent)


def _can_link(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _tokens(df: DataFrame, rules: JoinRules) -> DataFrame:
    """node, part, tokens: the sets of the rows of df (node, text), cut into rules.parts ranges of the global order."""
    schema = "node long, part int, tokens array<long>"
    width = np.full(1, rules.parts)

    def cut(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            node = batch.column(0).to_numpy()
            for a, _, part, places in slices(data, offsets):
                h, doc = ngram_sets(part, places, rules.words)
                if not len(h):
                    continue
                piece = _fragment(h, width)
                new = np.ones(len(h), bool)
                new[1:] = (piece[1:] != piece[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(new)
                lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(h)).astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(node[a + doc[at]]), pa.array(piece[at].astype(np.int32)), lists], ["node", "part", "tokens"])

    return df.select("node", "text").mapInArrow(lean(cut), schema)


def _verified(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """u, v, overlap of the pairs (u, nu, v, nv) that link: partial overlaps by part, summed for each pair."""
    left = tokens.select(F.col("node").alias("u"), "part", F.col("tokens").alias("tu"))
    right = tokens.select(F.col("node").alias("v"), "part", F.col("tokens").alias("tv"))
    met = pairs.join(left, "u").join(right, ["v", "part"])
    partial = met.groupBy("u", "v", "nu", "nv", "part").agg(F.max(F.size(F.array_intersect("tu", "tv"))).alias("n"))
    total = partial.groupBy("u", "v", "nu", "nv").agg(F.sum("n").alias("overlap"))
    return total.where((100 + percent) * F.col("overlap") >= percent * (F.col("nu") + F.col("nv"))).select("u", "v", "overlap")


def block_links(tokens: np.ndarray, size: np.ndarray, copies: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Links of each set with the sets on the other side, each as often as it has copies.

    tokens: the n-grams of set after set (size of them each); left, right: masks of sets, equal or without a common set.
    """
    out = np.zeros(len(size), np.int64)
    _, col, seen = np.unique(tokens, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(size)), size)
    several = seen[col] > 1  # an n-gram of one set is in no overlap
    col, row = (np.cumsum(seen > 1) - 1)[col[several]], row[several]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    a, b = np.flatnonzero(left), np.flatnonzero(right)
    width = max(1024, (1 << 22) // max(1, len(size)))
    both = np.zeros((len(a), len(b)), np.int64)
    for begin in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        at = slice(*np.searchsorted(col, [begin, begin + width]))
        has = np.zeros((len(size), min(width, int(col[-1]) + 1 - begin)), np.float32)
        has[row[at], col[at] - begin] = 1
        both += (has[a] @ has[b].T).astype(np.int64)
    link = (100 + percent) * both >= percent * (size[a][:, None] + size[b][None, :])
    if np.array_equal(a, b):
        np.fill_diagonal(link, False)
        out[a] = link @ copies[a]
    else:
        out[a], out[b] = link @ copies[b], link.T @ copies[a]
    return out


def _link_counts(texts: DataFrame, nodes: DataFrame, labels: DataFrame, rules: JoinRules) -> DataFrame:
    """node, others: rows whose set differs from that of the node and links with it.  labels: node, label."""
    inside = labels.join(nodes.select("node", "n", "copies"), "node")
    sized = inside.groupBy("label").agg(F.ceil(F.greatest(F.count("*") / rules.block_rows, F.sum("n") / rules.block_tokens)).cast("int").alias("blocks"))
    info = written(inside.join(sized.where("blocks > 1"), "label", "left").select("node", "label", "copies", F.coalesce("blocks", F.lit(1)).alias("blocks")), "linked")
    whole = written(_tokens(texts.join(info.select("node"), "node", "left_semi"), JoinRules(rules.words, rules.percent, parts=1)), "whole-sets")
    tidy(texts.sparkSession)
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = whole.join(info, "node").select("node", "label", "copies", "tokens", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = placed.select("label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "copies", "tokens")

    def group(key, batches):
        t = pa.Table.from_batches(batches).combine_chunks()
        _, first = np.unique(t["node"].to_numpy(), return_index=True)  # a text that is there twice made its set twice
        t = t.take(pa.array(first)).combine_chunks()
        lists = t["tokens"].chunk(0)
        node, copies, own = (t[c].to_numpy() for c in ("node", "copies", "own"))
        n = block_links(lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()).astype(np.int64), copies, own == key[1], own == key[2], rules.percent)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(n)], ["node", "others"])

    def count(batches):
        key, held = None, []
        for batch in batches:
            keys = [batch.column(k).to_numpy() for k in range(3)]
            turn = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            for a, b in zip([0, *turn.tolist()], [*turn.tolist(), batch.num_rows], strict=True):
                if b > a:
                    now = tuple(int(k[a]) for k in keys)
                    if held and now != key:
                        yield group(key, held)
                        held = []
                    key = now
                    held.append(batch.slice(a, b - a))
        if held:
            yield group(key, held)

    dealt = placed.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j")
    partial = dealt.mapInArrow(lean(count), "node long, others long")
    out = written(partial.groupBy("node").agg(F.sum("others").alias("others")), "link-counts")
    drop(info, whole)
    tidy(texts.sparkSession)
    return out


def ngram_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: JoinRules = JoinRules(), links: bool = False, labels: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, set_id, tkey, (links) n_links and (labels) label of every row of df.

    n_links is the number of other rows that the row links with, copies and repeated rows included.
    label numbers components, whatever their ids are (null: empty set).

    component_id is the least doc_id that links lead to, the row's own if it has none; a null or empty text has the
    empty set, which links with nothing.  Rows without an id have the least id of their component, null if it has none.
    set_id numbers equal sets (null: empty); tkey is the hash of the text.  Repeated rows are copies of each other and
    each stays a row; an empty table gives an empty one; a similarity of exactly the threshold links.  Texts are taken
    whole, however long (in parts of a megabyte; the distinct n-grams of one text must fit a worker).  Other columns of
    df, whatever their names, aren't looked at.

    Sets are equal if their size and the 64-bit sum of their mixed n-gram hashes are; texts never meet themselves.
    """
    spark = df.sparkSession
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    docs = docs.select("doc", F.xxhash64(F.col("text")).alias("tkey"), "text")

    def sets(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for a, b, part, places in slices(data, offsets):
                size, node = set_hashes(*ngram_sets(part, places, rules.words), b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(node.view(np.int64)), pa.array(size.astype(np.int64))], ["doc", "tkey", "node", "n"])

    tidy(spark)
    every = written(docs.mapInArrow(lean(sets), "doc long, tkey long, node long, n long"), "documents")
    least = F.min(F.struct(F.col("doc").isNull().alias("x"), "doc", "tkey")).alias("r")
    nodes = written(every.where("n > 0").groupBy("node", "n").agg(least, F.count("*").alias("copies")).select("node", "n", "r.doc", "r.tkey", "copies"), "nodes")
    linked = _links(docs, nodes, rules, links)
    labelled = written(nodes.join(linked[0], "node").select("node", "n", "label", "doc"), "labelled")
    least = written(labelled.groupBy("label").agg(F.min("doc").alias("component")), "least-ids")
    final = nodes.join(labelled.join(least, "label").select("node", "n", "component", "label"), ["node", "n"], "left").select("node", "n", F.coalesce("component", "doc").alias("component"), "copies", *(["label"] if labels else []))
    if links:
        final = final.join(linked[1], "node", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("others", F.lit(0)))
    final = written(final.drop("copies", "others"), "components")
    out = every.join(final, ["node", "n"], "left")
    counted = [F.when(F.col("n") > 0, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links")] if links else []
    counted += [F.when(F.col("n") > 0, F.coalesce("label", "node")).alias("label")] if labels else []
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc")).alias("component_id"), F.when(F.col("n") > 0, F.col("node")).alias("set_id"), "tkey", *counted)


def _links(docs: DataFrame, nodes: DataFrame, rules: JoinRules, count: bool) -> tuple[DataFrame, DataFrame | None]:
    """node, label of the nodes that link with another, and (count) node, others: how many other rows they link with."""
    spark = docs.sparkSession
    asked = nodes.select(F.col("doc").alias("d"), F.col("tkey").alias("k"), "node", "n")
    texts = written(docs.join(asked, docs["doc"].eqNullSafe(F.col("d")) & (docs["tkey"] == F.col("k"))).select("node", "n", "text"), "texts")
    tidy(spark)
    members, maps = _members(texts, rules)
    labels = _labels(texts, members, maps, rules)
    drop(maps)
    others = _link_counts(texts, nodes, labels, rules) if count else None
    drop(texts)
    tidy(spark)
    return labels, others


def _members(texts: DataFrame, rules: JoinRules) -> tuple[DataFrame, DataFrame]:
    """b, node, n: the nodes of each fragment that several have and none leaves out; node and its parity map."""
    spark, p = texts.sparkSession, rules.percent

    def hashes_of(batch):
        data, offsets = text_buffer(batch.column(0))
        for a, b, part, places in slices(data, offsets):
            yield signatures(*ngram_sets(part, places, rules.words), b - a, p)[0]

    rows_a_word = 6.0 * (100 - p) / (100 + p)
    shared, bits = sketch.build(texts.select("text"), hashes_of, 3 * rows_a_word * sketch.total_bytes(texts, "text") / 6)
    extra = size_ranges(p)[3]

    def rows(batches):
        for batch in batches:
            node, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = text_buffer(batch.column(2))
            for a, b, part, places in slices(data, offsets):
                h, of = ngram_sets(part, places, rules.words)
                whole = np.zeros(b - a, np.int32)
                maps = [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in parity_maps(h, of, b - a).T]
                yield pa.RecordBatch.from_arrays([pa.nulls(b - a, pa.int64()), pa.array(node[a:b]), pa.array(n[a:b]), pa.array(whole), pa.array(whole), *maps], names)
                key, doc, inst = signatures(h, of, b - a, p)
                keep = sketch.repeated(shared.value, key, bits)
                key, doc, inst = key[keep], doc[keep], inst[keep]
                none = pa.nulls(len(key), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node[a + doc]), pa.array(n[a + doc]), pa.array(inst.astype(np.int32)), pa.array(extra[inst].astype(np.int32)), *[none] * len(PARITY)], names)

    names = ["b", "node", "n", "inst", "extra", *PARITY]
    tidy(spark)
    found = written(texts.select("node", "n", "text").mapInArrow(lean(rows), "b long, node long, n long, inst int, extra int, " + ", ".join(f"{c} long" for c in PARITY)), "signatures")
    shared.destroy()  # what it was for is a written table
    maps = written(found.where("b is null").groupBy("node").agg(*(F.first(c).alias(c) for c in PARITY)), "maps")
    # a text that is there twice makes its rows twice
    distinct = written(found.where("b is not null").groupBy("b", "node").agg(*(F.first(c).alias(c) for c in ("n", "inst", "extra"))), "distinct")
    drop(found)
    tidy(spark)
    several = written(distinct.groupBy("b").agg(F.count("*").alias("m")).where("m > 1"), "several")
    ranked = distinct.join(several, "b").withColumn("rank", F.row_number().over(Window.partitionBy("node", "inst").orderBy(F.desc("m"), F.desc("b"))))
    members = written(ranked.where("rank > extra").select("b", "node", "n"), "members")
    drop(distinct, several)
    tidy(spark)
    return members, maps


def _labels(texts: DataFrame, members: DataFrame, maps: DataFrame, rules: JoinRules) -> DataFrame:
    """node, label of the nodes that link with another."""
    p, spark = rules.percent, texts.sparkSession
    none = spark.createDataFrame([], "node long, label long")
    if members.isEmpty():
        return none

    def tokens_of(pairs: DataFrame) -> DataFrame:
        """The sets of the nodes of pairs."""
        asked = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        out = written(_tokens(texts.join(asked, "node", "left_semi"), rules), "tokens")
        tidy(spark)
        return out

    degree = members.groupBy("node").agg(F.count("*").alias("deg"))
    ranked = written(members.join(degree, "node"), "ranked")
    drop(members)
    tidy(spark)
    links, labels = None, none

    def with_labels() -> DataFrame:
        return ranked.join(labels, "node", "left").select("b", "node", "n", "deg", F.coalesce("label", "node").alias("label"))

    def mapped(df: DataFrame, node: str, prefix: str) -> DataFrame:
        return df.join(maps.select(F.col("node").alias(node), *(F.col(c).alias(f"{prefix}{c}") for c in PARITY)), node)

    def add(pairs: DataFrame) -> bool:
        nonlocal links, labels
        near = mapped(mapped(pairs, "u", "a_"), "v", "b_").where(_near_enough("a_", "b_", "nu", "nv", p))
        pairs = written(near.select("u", "nu", "v", "nv"), "pairs")
        tidy(spark)
        if pairs.isEmpty():
            return False
        tokens = tokens_of(pairs)
        new = written(_verified(pairs, tokens, p), "links")
        drop(pairs, tokens)
        tidy(spark)
        links = new if links is None else links.unionByName(new)
        labels = components(links)
        return True

    def pairs_of(one: DataFrame, other: DataFrame, close: bool = False) -> DataFrame:
        """Distinct pairs of nodes of a fragment whose components differ and whose sizes (close: and parity maps) allow a link."""
        o = other.select("b", F.col("node").alias("o"), F.col("n").alias("no"), F.col("label").alias("lo"), *(F.col(f"a_{c}").alias(f"b_{c}") for c in PARITY if close))
        good = (F.col("label") != F.col("lo")) & _can_link(F.col("n"), F.col("no"), p)
        met = one.alias("x").join(o.alias("y"), (F.col("x.b") == F.col("y.b")) & good & (_near_enough("a_", "b_", "n", "no", p) if close else F.lit(True)))
        up = F.col("node") < F.col("o")
        pick = lambda a, b, name: F.when(up, F.col(a)).otherwise(F.col(b)).alias(name)
        return met.select(pick("node", "o", "u"), pick("n", "no", "nu"), pick("o", "node", "v"), pick("no", "n", "nv")).distinct()

    for r in range(rules.pivot_rounds):
        now = written(with_labels(), "round")
        order = F.struct("deg", "node") if r == 0 else F.struct(F.xxhash64("node", F.lit(r)).alias("deg"), F.col("node"))
        pivots = written(now.groupBy("b").agg(F.max_by(F.struct("node", "n", "label"), order).alias("p")).select("b", "p.*"), "pivots")
        more = add(pairs_of(now, pivots))
        drop(now, pivots)
        if not more:
            break
    # the rest, exactly: in each fragment the nodes outside its largest component with all of another component
    now = written(with_labels(), "rest")
    main = now.groupBy("b", "label").agg(F.count("*").alias("m")).groupBy("b").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.count("*").alias("k")).where("k > 1").select("b", "main")
    open_ = written(mapped(now.join(written(main, "main"), "b"), "node", "a_"), "open")
    drop(now, ranked)
    tidy(spark)
    add(pairs_of(open_.where("label <> main").drop("main", "deg"), open_, close=True))
    drop(open_)
    tidy(spark)
    return labels


def near_duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: JoinRules = JoinRules(words=5, percent=80)) -> DataFrame:
    """doc_id, component_id: groups of near duplicates (five words, 0.8)."""
    return ngram_components(df, id_col, text_col, rules).select("doc_id", "component_id")
