"""The three end-to-end plans: graph, motif, community."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CommunityConfig, GraphConfig, MotifConfig
from ..functions.tables import settled
from ..operators import communities, detection, edges, encoding, features, motifs, significance, tracking, windows
from ..sources.sinks import save_all, save_json, save_table


@dataclass
class GraphResult:
    transactions: DataFrame
    node_map: DataFrame
    temporal_edges: DataFrame
    snapshot_edges: DataFrame
    second_order_edges: DataFrame
    adjacency: DataFrame

    def save(self, folder: str, fmt: str = "parquet") -> dict[str, str]:
        names = ("transactions", "node_map", "temporal_edges", "second_order_edges")
        return save_all({n: getattr(self, n) for n in names}, folder, fmt)


def graph_pipeline(df: DataFrame, cfg: GraphConfig = GraphConfig(), all_windows: bool = True) -> GraphResult:
    """Canonical transactions of over cfg.min_amount to encoded ones and their edge tables by window (or of the first
    window alone)."""
    df = df.where(F.col("amount") > cfg.min_amount)
    encoded, node_map = encoding.fit_transform(df)
    encoded = settled(encoded)
    rows = encoded
    if not all_windows:  # the first window begins at the least step: its steps reach the scan
        first = encoded.agg(F.min("step")).first()[0]
        rows = windows.filter_window(encoded, first, first + cfg.window_size - 1) if first is not None else encoded
    rows = windows.assign_windows(rows, cfg.window_size, cfg.window_stride)
    rows = windows.number_windows(rows if all_windows else rows.where("window_index = 0"))
    keys = ("window_id",)
    relay = edges.temporal_edges(rows, cfg.delta_w, keys, bucketed=True)
    snapshot = edges.snapshot_edges(rows, keys)
    return GraphResult(encoded, node_map, relay, snapshot, edges.second_order_edges(relay, keys), edges.adjacency(snapshot, keys))


@dataclass
class MotifResult:
    instances: DataFrame
    support: DataFrame
    zscores: DataFrame | None
    kept: DataFrame
    entity: DataFrame
    wide: DataFrame
    by_window: DataFrame
    window_size: int = 7

    def save(self, folder: str, fmt: str = "parquet") -> dict[str, str]:
        """The feature tables; motif_instances, partitioned by the window of the first step; motif_support.json, with the
        support before and after the filter and the z-scores."""
        out = save_all({"entity_motif_features": self.entity, "entity_motif_wide": self.wide, "window_motif_features": self.by_window}, folder, fmt)
        start = (F.floor(F.array_min("steps") / F.lit(self.window_size)) * self.window_size).cast("int")
        out["motif_instances"] = save_table(self.kept.withColumn("window_start", start), "motif_instances", folder, "parquet", ("window_start",))
        support = lambda df: {r["motif_type"]: r["support"] for r in df.collect()}  # noqa: E731  a row a type
        zscores = {} if self.zscores is None else {r["motif_type"]: {k: v for k, v in r.asDict().items() if k != "motif_type"} for r in self.zscores.collect()}
        report = {"raw_support": support(self.support), "filtered_support": support(significance.count_support(self.kept)), "zscore_table": zscores}
        out["motif_support"] = save_json(self.support.sparkSession, report, f"{folder}/motif_support.json")
        return out


def motif_pipeline(events: DataFrame, cfg: MotifConfig = MotifConfig(), with_zscores: bool = False, window_size: int = 7) -> MotifResult:
    """Events (with event_id) to instances, support, significance and features.  Support is that of the whole table."""
    events = settled(motifs.hub_prune(events, cfg.hub_quantile) if cfg.hub_quantile is not None else events)
    found = settled(motifs.run_all(events, cfg))
    zscores = settled(significance.null_zscore(found, events, cfg)) if with_zscores else None
    kept = significance.filter_motifs(found, cfg, zscores)
    volume = events.select(F.sum("amount").alias("v")).scalar()
    kept = kept if zscores is None else settled(kept)
    entity = features.entity_features(kept, zscores, features.node_degrees(events), volume)
    return MotifResult(found, significance.count_support(found), zscores, kept, entity, features.entity_wide(entity), features.window_features(kept, window_size), window_size)


@dataclass
class CommunityResult:
    assignments: DataFrame
    features: DataFrame
    shortlist: DataFrame
    summary: DataFrame

    def save(self, folder: str, fmt: str = "parquet") -> dict[str, str]:
        return save_all({"community_assignments": self.assignments, "community_features": self.features, "community_shortlist": self.shortlist}, folder, fmt)


def community_pipeline(df: DataFrame, cfg: CommunityConfig = CommunityConfig(), window_size: int = 30, window_stride: int = 15, found: DataFrame | None = None, amount: str = "amount") -> CommunityResult:
    """Transactions to tracked, scored communities.  Windows under two rows give no communities but count as windows.

    found: motif instances; each counts for a community of a window if its events lie in the window and its nodes in
    the community.
    """
    if amount not in df.columns:
        raise ValueError(f"no column {amount}; found {df.columns}")
    keys = ("window_id",)
    rows = df.withColumn("amount", F.col(amount))
    rows = settled(windows.number_windows(windows.assign_windows(rows, window_size, window_stride)))
    spans = rows.select("window_id", "window_index", "step_start", "step_end").distinct()
    many = rows.groupBy("window_id").agg(F.count("*").alias("n")).where("n > 1").select("window_id")
    graph = edges.snapshot_edges(rows.join(many, "window_id", "left_semi"), keys)
    if cfg.weighted:
        graph = communities.apply_weighting(graph, cfg, window_size, keys)
    labels = detection.detect_communities(edges.adjacency(graph, keys), cfg, keys, split=cfg.s_max > 0)
    record = settled(tracking.track(labels, cfg)).join(spans.drop("window_index"), "window_id")
    named = record.select("window_id", "node", "global_cid")
    roles = communities.node_roles(rows, cfg, keys)
    counts = None
    if found is not None:
        first = df.select(F.min("step").alias("o")).scalar()
        placed = windows.assign_windows(found.withColumn("__first", F.array_min("steps")), window_size, window_stride, "__first", first)
        inside = placed.where(F.array_max("steps") <= F.col("step_end")).drop("step_start", "step_end").join(spans.select("window_index", "window_id"), "window_index")
        counts = communities.motif_counts(inside, named, keys)
    feats = communities.community_features(rows, named, roles, counts, keys).join(spans.drop("window_index"), "window_id")
    total = spans.select(F.count("*").alias("n")).scalar()
    scored = settled(communities.score_communities(settled(feats), cfg, tracking.persistence(record), total))
    return CommunityResult(record, scored, communities.shortlist(scored, cfg), communities.score_summary(scored, df, cfg))
