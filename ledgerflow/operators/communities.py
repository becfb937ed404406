"""Community operators: edge weighting, node roles, features, scores."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CommunityConfig, MotifConfig
from ..functions.tables import settled
from .motifs import run_all

NOISE = -1
EPS = 1e-9


def apply_weighting(edges: DataFrame, cfg: CommunityConfig = CommunityConfig(), delta_w: int = 30, keys: tuple[str, ...] = (), sparsify: bool = True) -> DataFrame:
    """edges with weight times a money factor (how far the source's outflow is from the target's inflow) and a time
    factor (avg_gap, if there is one); weak edges go, and top_k_neighbors of each source stay.  Adds node_out, node_in."""
    rows = edges.withColumn("node_out", F.sum("weight").over(Window.partitionBy(*keys, "src_node"))).withColumn("node_in", F.sum("weight").over(Window.partitionBy(*keys, "dst_node")))
    money = F.exp(-cfg.alpha * F.abs(F.ln(F.col("node_out") / (F.col("node_in") + EPS) + EPS)))
    time = F.exp(-cfg.beta * F.col("avg_gap") / max(delta_w, 1)) if "avg_gap" in edges.columns else F.lit(1.0)
    rows = rows.withColumn("weight", F.col("weight") * money * time).where(F.col("weight") >= cfg.weight_filter_thresh)
    if not sparsify or cfg.top_k_neighbors <= 0:
        return rows
    best = Window.partitionBy(*keys, "src_node").orderBy(F.col("weight").desc(), "dst_node")
    return rows.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= cfg.top_k_neighbors).drop("__r")


def drop_small(labels: DataFrame, cfg: CommunityConfig = CommunityConfig(), keys: tuple[str, ...] = ("window_id",)) -> DataFrame:
    """Labels of communities under min_comm_size become noise; the others keep theirs."""
    sizes = labels.groupBy(*keys, "community_id").agg(F.count("*").alias("__n"))
    out = labels.join(sizes, [*keys, "community_id"])
    return out.withColumn("community_id", F.when(F.col("__n") < cfg.min_comm_size, F.lit(NOISE)).otherwise(F.col("community_id"))).select(*labels.columns)


def node_roles(df: DataFrame, cfg: CommunityConfig = CommunityConfig(), keys: tuple[str, ...] = ()) -> DataFrame:
    """Volumes, counts, balance and role of each node (0 neutral, 1 source, 2 sink, 3 layering; layering wins, then sink)."""
    alert = (F.col("is_sar") if "is_sar" in df.columns else F.lit(0)).cast("int")
    end = lambda node, out: F.struct(F.col(node).alias("node"), F.lit(out).alias("out"))
    rows = df.select(*keys, F.explode(F.array(end("src_node", 1), end("dst_node", 0))).alias("e"), F.col("amount").cast("double").alias("a"), alert.alias("x"))
    out = F.col("e.out") == 1
    rows = rows.groupBy(*keys, F.col("e.node").alias("node")).agg(
        F.sum(F.when(out, F.col("a")).otherwise(0.0)).alias("total_volume_out"), F.sum(F.when(~out, F.col("a")).otherwise(0.0)).alias("total_volume_in"),
        F.count("a").cast("int").alias("n_tx"), F.sum("x").cast("int").alias("n_alert_tx"),
    )
    o, i = F.col("total_volume_out"), F.col("total_volume_in")
    rows = rows.withColumns({
        "total_volume": o + i, "alert_rate": F.col("n_alert_tx") / (F.col("n_tx") + EPS), "net_flow_ratio": (o - i) / (o + i + EPS), "flow_consistency": 2 * F.least(o, i) / (o + i + EPS),
    })
    net, even = F.col("net_flow_ratio"), F.col("flow_consistency")
    rows = rows.withColumn("layering_score", even * (1 - F.abs(net)))
    layering = (even > cfg.layering_consistency) & (F.abs(net) < cfg.role_threshold * 0.67)
    role = F.when(layering, 3).when(net < -cfg.role_threshold, 2).when(net > cfg.role_threshold, 1).otherwise(0)
    return rows.select(*keys, "node", "total_volume", "total_volume_out", "total_volume_in", "n_tx", "n_alert_tx", "alert_rate", "net_flow_ratio", "flow_consistency", "layering_score", role.alias("role"))


def labelled_edges(df: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Edges (weight, n_tx, n_alert) whose two ends have a community: src_cid, dst_cid.  labels: node, global_cid."""
    alert = F.col("is_sar").cast("bigint") if "is_sar" in df.columns else F.lit(0).cast("bigint")
    edges = df.groupBy(*keys, "src_node", "dst_node").agg(F.sum(F.col("amount").cast("double")).alias("weight"), F.count("amount").alias("n_tx"), F.sum(alert).alias("n_alert"))
    member = labels.where(F.col("global_cid") != NOISE)
    for end in ("src", "dst"):
        m = member.select(*keys, F.col("node").alias(f"{end}_node"), F.col("global_cid").alias(f"{end}_cid"))
        edges = edges.join(m, [*keys, f"{end}_node"])
    return edges


def motif_counts(found: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """global_cid, motif_count: instances whose nodes all lie in one community."""
    rows = found.withColumn("__i", F.xxhash64("motif_type", F.array_join("edges", ","))).select(*keys, "__i", F.explode(F.array_distinct("nodes")).alias("node"), F.size(F.array_distinct("nodes")).alias("__n"))
    inside = rows.join(labels.where(F.col("global_cid") != NOISE).select(*keys, "node", "global_cid"), [*keys, "node"])
    whole = inside.groupBy(*keys, "__i", "global_cid").agg(F.count("*").alias("__m"), F.first("__n").alias("__n")).where("__m = __n")
    return whole.groupBy(*keys, "global_cid").agg(F.count("*").alias("motif_count"))


def motif_counts_within(df: DataFrame, labels: DataFrame, cfg: MotifConfig = MotifConfig(), keys: tuple[str, ...] = ()) -> DataFrame:
    """motif_counts() of the instances that run_all() finds in the events df, for all enabled types.

    Both ends of an event meet their labels once, so no instance does.  Chains and split-merge paths consist of events
    between their own nodes, so they are looked for among the events inside a community.  Fans are greedy over all events
    of a node, so they are found in the whole table, with nodes that carry their labels; so is everything with
    max_instances, which takes the first of all.  A node without a label is in no community.
    """
    events = df
    for end in ("src", "dst"):
        label = labels.select(*keys, F.col("node").alias(f"{end}_node"), F.col("global_cid").alias(f"__{end}"))
        events = events.join(label, [*keys, f"{end}_node"], "left").withColumn(f"__{end}", F.coalesce(f"__{end}", F.lit(NOISE)))
    events = settled(events)
    whole = cfg.enabled if cfg.max_instances else tuple(t for t in cfg.enabled if t in ("fanin", "fanout"))
    paths, own, found = tuple(t for t in cfg.enabled if t not in whole), (*keys, "global_cid"), []
    if whole:
        node = {f"{end}_node": F.struct(F.col(f"{end}_node").alias("node"), F.col(f"__{end}").alias("cid")) for end in ("src", "dst")}
        cids = F.array_distinct(F.col("nodes")["cid"])
        rows = run_all(events.withColumns(node), replace(cfg, enabled=whole), keys).where((F.size(cids) == 1) & (cids[0] != NOISE))
        found.append(rows.select(*keys, cids[0].alias("global_cid")))
    if paths:
        inner = events.where((F.col("__src") == F.col("__dst")) & (F.col("__src") != NOISE)).withColumnRenamed("__src", "global_cid")
        found.append(run_all(settled(inner, *own, "src_node", "step"), replace(cfg, enabled=paths), own).select(*own))
    return reduce(DataFrame.unionByName, found).groupBy(*own).agg(F.count("*").alias("motif_count"))


def community_features(df: DataFrame, labels: DataFrame, roles: DataFrame | None = None, motifs: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Features of each community with an internal edge.  labels: node, global_cid; roles as node_roles(); motifs:
    global_cid, motif_count.  external_flow is the share of outgoing flow, and external_noise the same."""
    edges = labelled_edges(df, labels, keys)
    total = edges.groupBy(*keys).agg(F.sum("weight").alias("__total"))
    inner = F.col("src_cid") == F.col("dst_cid")
    basics = edges.groupBy(*keys, F.col("src_cid").alias("global_cid")).agg(
        F.sum(F.when(inner, F.col("weight"))).alias("total_volume"), F.count(F.when(inner, 1)).alias("n_internal_edges"),
        F.avg(F.when(inner, (F.col("n_alert") > 0).cast("double"))).alias("alert_ratio"), F.sum(F.when(~inner, F.col("weight")).otherwise(0.0)).alias("__ext"),
    ).where("n_internal_edges > 0")
    internal = edges.where(inner).select(*keys, "src_node", "dst_node", F.col("src_cid").alias("global_cid"), "weight")
    back = internal.select(*keys, "global_cid", F.col("dst_node").alias("src_node"), F.col("src_node").alias("dst_node"))
    returned = internal.join(back, [*keys, "global_cid", "src_node", "dst_node"], "left_semi").groupBy(*keys, "global_cid").agg(F.sum("weight").alias("__back"))
    ends = internal.select(*keys, "global_cid", F.explode(F.array(F.struct(F.lit(1).alias("o"), F.col("src_node").alias("n")), F.struct(F.lit(0).alias("o"), F.col("dst_node").alias("n")))).alias("e"), "weight")
    flow = ends.groupBy(*keys, "global_cid", "e").agg(F.sum("weight").alias("v")).groupBy(*keys, "global_cid").agg(
        F.max(F.when(F.col("e.o") == 0, F.col("v"))).alias("__in_max"), F.sum(F.when(F.col("e.o") == 0, F.col("v"))).alias("__in"),
        F.max(F.when(F.col("e.o") == 1, F.col("v"))).alias("__out_max"), F.sum(F.when(F.col("e.o") == 1, F.col("v"))).alias("__out"),
    )
    member = labels.where(F.col("global_cid") != NOISE)
    if roles is not None:
        member = member.join(roles.select(*keys, "node", "role", "layering_score"), [*keys, "node"], "left")
        count = lambda r: F.count(F.when(F.col("role") == r, 1))
        sizes = member.groupBy(*keys, "global_cid").agg(F.count("*").alias("size"), count(1).alias("n_sources"), count(2).alias("n_sinks"), count(3).alias("n_layering"), F.avg("layering_score").alias("avg_layering_score"))
    else:
        zero = F.lit(0).cast("bigint")
        sizes = member.groupBy(*keys, "global_cid").agg(F.count("*").alias("size")).select(*keys, "global_cid", "size", zero.alias("n_sources"), zero.alias("n_sinks"), zero.alias("n_layering"), F.lit(0.0).alias("avg_layering_score"))
    on = [*keys, "global_cid"]
    out = basics.join(flow, on).join(sizes, on).join(returned, on, "left")
    out = out.join(total, list(keys)) if keys else out.withColumn("__total", total.select("__total").scalar())
    out = out.join(motifs.select(*on, "motif_count"), on, "left") if motifs is not None else out.withColumn("motif_count", F.lit(0))
    size, volume = F.col("size"), F.col("total_volume")
    internal_flow, external = volume / (F.col("__total") + EPS), F.col("__ext") / (F.col("__total") + EPS)
    again = F.coalesce("__back", F.lit(0.0)) / (volume + EPS)
    return out.select(
        *on, size, internal_flow.alias("internal_flow"), external.alias("external_flow"), external.alias("external_noise"), again.alias("reciprocity"), again.alias("internal_recirc"),
        (F.col("__in_max") / (F.col("__in") + EPS)).alias("sink_concentration"), (F.col("__out_max") / (F.col("__out") + EPS)).alias("source_concentration"),
        "n_sources", "n_sinks", "n_layering", F.coalesce("avg_layering_score", F.lit(0.0)).alias("avg_layering_score"), volume, "n_internal_edges", "alert_ratio",
        (F.coalesce("motif_count", F.lit(0)) / F.greatest(size, F.lit(1))).alias("motif_enrichment"), (volume / (size + EPS)).alias("vol_density"),
        (F.col("n_internal_edges") / (size * (size - 1) + EPS)).alias("edge_density"), F.lit(0.0).alias("persistence"),
    )


def _unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def score_communities(features: DataFrame, cfg: CommunityConfig = CommunityConfig(), persistence: DataFrame | None = None, max_windows: int | Column = 1) -> DataFrame:
    """features with norms, suspicion_score, is_suspicious and four flags.  persistence: global_cid, n_windows.

    Motif enrichment is divided by its largest value over all rows, one number.  min_flow_for_scoring, if set, leaves
    out communities with less volume.
    """
    rows = features
    if cfg.min_flow_for_scoring is not None:
        rows = rows.where(F.col("total_volume") >= cfg.min_flow_for_scoring)
    if persistence is not None:
        rows = rows.drop("persistence").join(persistence.select("global_cid", F.col("n_windows").cast("double").alias("persistence")), "global_cid", "left").withColumn("persistence", F.coalesce("persistence", F.lit(0.0)))
    windows = F.greatest(max_windows if isinstance(max_windows, Column) else F.lit(max_windows), F.lit(1))
    most = F.coalesce(rows.select(F.max("motif_enrichment").alias("m")).scalar(), F.lit(0.0))
    rows = rows.withColumn("persistence_norm", _unit(F.col("persistence") / windows)).withColumn("motif_enrichment_norm", _unit(F.col("motif_enrichment") / F.when(most > 0, most).otherwise(1.0)))
    score = (
        cfg.w_internal_flow * _unit(F.col("internal_flow")) + cfg.w_reciprocity * _unit(F.col("reciprocity")) + cfg.w_persistence * F.col("persistence_norm")
        + cfg.w_motif * F.col("motif_enrichment_norm") - cfg.w_external_noise * _unit(F.col("external_noise")) - cfg.size_penalty_gamma * F.log1p("size")
    )
    flag = lambda c: c.cast("int")
    rows = rows.withColumn("suspicion_score", F.greatest(F.lit(0.0), score))
    return rows.withColumns({
        "is_suspicious": flag(F.col("suspicion_score") >= cfg.global_susp_threshold), "flag_internal_flow": flag(F.col("internal_flow") >= 0.5), "flag_reciprocity": flag(F.col("reciprocity") >= 0.3),
        "flag_persistence": flag(F.col("persistence_norm") >= 0.3), "flag_motif": flag(F.col("motif_enrichment") >= 1.0),
    })


def shortlist(scored: DataFrame, cfg: CommunityConfig = CommunityConfig()) -> DataFrame:
    """The top_k_export suspicious communities, best first."""
    order = [F.col("suspicion_score").desc(), *(F.col(c) for c in ("window_id", "global_cid") if c in scored.columns)]
    return scored.where("is_suspicious = 1").orderBy(*order).limit(cfg.top_k_export)


def score_summary(scored: DataFrame, transactions: DataFrame, cfg: CommunityConfig = CommunityConfig()) -> DataFrame:
    """One row: communities, suspicious ones, mean score, alert enrichment ratio, suspicious ones with few alerts."""
    bad = F.col("is_suspicious") == 1
    rate = transactions.agg(F.avg((F.col("is_sar") > 0).cast("double")).alias("r")).scalar()
    return scored.agg(
        F.count("*").alias("n_communities"), F.count(F.when(bad, 1)).alias("n_suspicious"), F.avg("suspicion_score").alias("mean_score"),
        (F.coalesce(F.avg(F.when(bad, F.col("alert_ratio"))), F.lit(0.0)) / F.greatest(F.coalesce(rate, F.lit(0.0)), F.lit(EPS))).alias("aer"), F.count(F.when(bad & (F.col("alert_ratio") < cfg.alert_thresh), 1)).alias("n_unknown"),
    )
