"""Tracking communities across windows by Jaccard overlap with what recent windows held."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CommunityConfig
from ..functions.tables import numbered, settled
from . import detection
from .communities import NOISE


def jaccard_overlap(current: DataFrame, past: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """cid, gcid, inter, jaccard of the pairs that share a node.  current: node, cid; past: node, gcid."""
    met = current.join(past, [*keys, "node"]).groupBy(*keys, "cid", "gcid").agg(F.count("*").alias("inter"))
    a = current.groupBy(*keys, "cid").agg(F.count("*").alias("na"))
    b = past.groupBy(*keys, "gcid").agg(F.count("*").alias("nb"))
    out = met.join(a, [*keys, "cid"]).join(b, [*keys, "gcid"])
    return out.select(*keys, "cid", "gcid", "inter", (F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))).alias("jaccard"))


def _strands(met: DataFrame, sizes: DataFrame) -> DataFrame:
    """__w, cid, strand: communities that overlaps link, over any number of windows, have one strand."""
    edges = met.select(F.lit(0).alias("k"), F.struct("__w", "cid").alias("i"), F.struct(F.col("__p").alias("__w"), F.col("pcid").alias("cid")).alias("j"), F.lit(1.0).alias("w"))
    g = detection._graph(settled(edges))
    parts, _ = detection._parts(g, g.nodes.withColumn("c", F.lit(0)))
    found = parts.select(F.col("u.__w").alias("__w"), F.col("u.cid").alias("cid"), F.col("c").alias("strand"))
    return sizes.select("__w", "cid").join(found, ["__w", "cid"], "left").select("__w", "cid", F.coalesce("strand", F.struct("__w", "cid")).alias("strand"))


def _claims(own: dict, past: dict, met: dict, thresh: float) -> dict:
    """Community to past one.  own, past: their sizes; met: community to past one to common nodes."""
    claims: dict = {}
    for cid, row in met.items():
        fits = [(-i / (own[cid] + past[g] - i), g) for g, i in row.items()]
        score, g = min(fits)
        if -score >= thresh:
            claims.setdefault(g, []).append((score, cid))
    return {min(c)[1]: g for g, c in claims.items()}


def _fold(thresh: float, memory: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function of row batches in order of strand and window.  Rows of kind 0 are communities (c, n), of kind 1 past
    ones (p, pc) with the nodes last seen in them, of kind 2 overlaps.  It holds one window of a strand and the names of
    its last `memory` windows, and gives each community the window and number of the one that it descends from."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names: dict = {}  # window and number of a community to those of the first of its line
        strand, at, out = None, None, []
        own, past, met = {}, {}, {}

        def finish() -> None:
            won = _claims(own, past, met, thresh)
            for cid in own:
                names[at, cid] = won.get(cid, (at, cid))
                out.append((at, cid, *names[at, cid]))
            for old in [x for x in names if x[0] <= at - memory]:
                del names[old]

        for batch in batches:
            for s_w, s_cid, w, kind, c, p, pc, n in batch.itertuples(index=False):
                if ((s_w, s_cid), w) != (strand, at):
                    if own:
                        finish()
                    if (s_w, s_cid) != strand:
                        names.clear()
                    strand, at = (s_w, s_cid), w
                    own, past, met = {}, {}, {}
                if kind == 0:
                    own[c] = n
                    continue
                g = names[p, pc]
                row = past if kind == 1 else met.setdefault(c, {})
                row[g] = row.get(g, 0) + n
            if len(out) > 100_000:
                yield pd.DataFrame(out, columns=["__w", "cid", "__b", "bcid"])
                out.clear()
        if own:
            finish()
        if out:
            yield pd.DataFrame(out, columns=["__w", "cid", "__b", "bcid"])

    return run


def track(labels: DataFrame, cfg: CommunityConfig = CommunityConfig()) -> DataFrame:
    """window_id, node, global_cid, community_size, overlap_score of every labelled node, noise (-1, size 0) included.

    labels: window_id, node, community_id.  A node counts for the community it was in last, in the tracking_memory
    windows before.  A community wants the past one with the largest Jaccard (at least jaccard_thresh; the lower id of
    equals).  A past one goes to the claim with the larger Jaccard (the lower community of equals); the others get new
    ids, in order of window and community.  overlap_score: the largest Jaccard with the window before, to 4 places.

    The number of jobs doesn't grow with that of the windows.  Sizes and overlaps of all windows are sums over one join,
    as the window that a node was last seen in doesn't depend on names; names then follow from a fold over rows of
    communities, strand by strand, so that only communities that overlaps link wait for each other.
    """
    labels = settled(labels)
    order = labels.select("window_id").distinct().withColumn("__w", F.row_number().over(Window.orderBy("window_id")).cast("long"))  # a row a window
    own = settled(labels.where(F.col("community_id") != NOISE).join(order, "window_id").select("__w", "node", F.col("community_id").cast("long").alias("cid")))
    until = F.col("__w") + cfg.tracking_memory
    later = own.withColumn("__until", F.least(until, F.coalesce(F.lead("__w").over(Window.partitionBy("node").orderBy("__w")), until)))
    last = settled(later.select(F.explode(F.sequence(F.col("__w") + 1, F.col("__until"))).alias("__w"), "node", F.col("__w").alias("__p"), F.col("cid").alias("pcid")))
    sizes = settled(own.groupBy("__w", "cid").agg(F.count("*").alias("n")))
    past = last.groupBy("__w", "__p", "pcid").agg(F.count("*").alias("n"))
    met = settled(own.join(last, ["__w", "node"]).groupBy("__w", "cid", "__p", "pcid").agg(F.count("*").alias("n")))
    strands = settled(_strands(met, sizes))
    no = F.lit(-1).cast("long")
    row = lambda kind, c, p, pc: (F.col("strand.__w").alias("s_w"), F.col("strand.cid").alias("s_cid"), F.col("__w").alias("w"), F.lit(kind).alias("kind"), c.alias("c"), p.alias("p"), pc.alias("pc"), "n")
    by_past = strands.select(F.col("__w").alias("__p"), F.col("cid").alias("pcid"), "strand")
    rows = sizes.join(strands, ["__w", "cid"]).select(*row(0, F.col("cid"), no, no))
    rows = rows.unionByName(past.join(by_past, ["__p", "pcid"]).select(*row(1, no, F.col("__p"), F.col("pcid"))))
    rows = rows.unionByName(met.join(strands, ["__w", "cid"]).select(*row(2, F.col("cid"), F.col("__p"), F.col("pcid"))))
    rows = rows.repartition("s_w", "s_cid").sortWithinPartitions("s_w", "s_cid", "w", "kind", "c", "p", "pc")
    names = settled(rows.mapInPandas(_fold(cfg.jaccard_thresh, cfg.tracking_memory), "__w long, cid long, __b long, bcid long"))
    ids = numbered(names.where("__w = __b and cid = bcid").select("__b", "bcid"), ("__b", "bcid"), "global_cid")
    before = met.where("__p = __w - 1").join(sizes, ["__w", "cid"], "left").select("__w", "cid", "__p", "pcid", met["n"].alias("i"), sizes["n"].alias("a"))
    before = before.join(sizes.select(F.col("__w").alias("__p"), F.col("cid").alias("pcid"), F.col("n").alias("b")), ["__p", "pcid"])
    best = before.groupBy("__w", "cid").agg(F.round(F.max(F.col("i") / (F.col("a") + F.col("b") - F.col("i"))), 4).alias("overlap_score"))
    named = names.join(ids, ["__b", "bcid"]).join(sizes, ["__w", "cid"]).join(best, ["__w", "cid"], "left").select("__w", "cid", "global_cid", F.col("n").alias("community_size"), "overlap_score")
    record = labels.join(order, "window_id").join(named, [F.col("community_id") == F.col("cid"), order["__w"] == named["__w"]], "left")
    return record.select("window_id", "node", F.coalesce("global_cid", F.lit(NOISE)).cast("long").alias("global_cid"), F.coalesce("community_size", F.lit(0)).cast("long").alias("community_size"), F.coalesce("overlap_score", F.lit(0.0)).alias("overlap_score"))


def persistence(record: DataFrame, as_of: bool = False) -> DataFrame:
    """global_cid, n_windows: windows a community was seen in; as_of: (window_id, global_cid) up to that window."""
    seen = record.where(F.col("global_cid") != NOISE).select("window_id", "global_cid").distinct()
    if not as_of:
        return seen.groupBy("global_cid").agg(F.count("*").alias("n_windows"))
    return seen.withColumn("n_windows", F.count("*").over(Window.partitionBy("global_cid").orderBy("window_id")))
