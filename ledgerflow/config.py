"""Settings of all operators.  Names and defaults of the fields are fixed values: they are part of the interface.

Kept, but read by nothing here (windows are arguments of the plans, and no clustering looks back): LoadConfig.window_size
and window_stride, window_sizes, CommunityConfig.lambda_temporal and stride.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Names in raw files and their canonical names.
COLUMN_NAMES = {
    "Timestamp": "timestamp",
    "From Bank": "src_bank",
    "Account": "src_node",
    "To Bank": "dst_bank",
    "Account.1": "dst_node",
    "Amount Received": "amount",
    "Receiving Currency": "currency",
    "Is Laundering": "is_sar",
    "step": "step",
    "nameOrig": "src_node",
    "nameDest": "dst_node",
    "amount": "amount",
    "type": "type",
    "isSAR": "is_sar",
    "oldbalanceOrig": "old_bal_src",
    "newbalanceOrig": "new_bal_src",
    "oldbalanceDest": "old_bal_dst",
    "newbalanceDest": "new_bal_dst",
}
# Canonical columns and their types.
COLUMN_TYPES = {"src_node": "bigint", "dst_node": "bigint", "amount": "float", "step": "int", "is_sar": "tinyint"}
# Older names of event columns, in order of preference.
EVENT_ALIASES = {"src_node": ("nameOrig", "src"), "dst_node": ("nameDest", "dst"), "is_sar": ("is_laundering", "Is Laundering", "isSAR")}
# Motif types, in the order of their matchers.
MOTIFS = ("fanin", "fanout", "cycle3", "relay4", "split_merge")


@dataclass(frozen=True)
class LoadConfig:
    names: dict = field(default_factory=lambda: dict(COLUMN_NAMES))
    types: dict = field(default_factory=lambda: dict(COLUMN_TYPES))
    keep: tuple[str, ...] = tuple(COLUMN_TYPES)
    min_amount: float = 0.0
    window_size: int = 30
    window_stride: int = 15


@dataclass(frozen=True)
class GraphConfig:
    window_sizes: tuple[int, ...] = (7, 14, 30)
    window_size: int = 30
    window_stride: int = 15
    delta_w: int = 5
    min_amount: float = 0.0


@dataclass(frozen=True)
class MotifConfig:
    """Options that are off by default: dedup_fanin, first_edge_only, strict_chronology, max_instances, hub_quantile."""

    delta: int = 3
    rho_min: float = 0.5
    rho_max: float = 2.0
    r_min_fanin: int = 3
    r_min_fanout: int = 3
    r_min_cycle: int = 1
    r_min_relay: int = 1
    r_min_split_merge: int = 1
    n_permutations: int = 30
    z_min: float = 2.0
    window_sizes: tuple[int, ...] = (7, 14, 30)
    enabled: tuple[str, ...] = MOTIFS
    dedup_fanin: bool = False
    first_edge_only: bool = False
    strict_chronology: bool = False
    max_instances: int | None = None
    hub_quantile: float | None = None

    def least_support(self) -> dict[str, int]:
        """Instances a type needs to be kept; fans have their own least degree, so one is enough."""
        return {"fanin": 1, "fanout": 1, "cycle3": self.r_min_cycle, "relay4": self.r_min_relay, "split_merge": self.r_min_split_merge}


@dataclass(frozen=True)
class CommunityConfig:
    alpha: float = 1.0
    beta: float = 0.5
    weight_filter_thresh: float = 0.01
    top_k_neighbors: int = 10
    method: str = "leiden"
    min_comm_size: int = 3
    resolution: float = 1.0
    lambda_temporal: float = 0.3
    s_max: int = 50
    resolution_multiplier: float = 1.5
    max_recursion_depth: int = 3
    role_threshold: float = 0.3
    layering_consistency: float = 0.8
    window_sizes: tuple[int, ...] = (7, 14, 30)
    stride: int = 7
    jaccard_thresh: float = 0.25
    tracking_memory: int = 3
    w_internal_flow: float = 0.30
    w_reciprocity: float = 0.20
    w_persistence: float = 0.25
    w_motif: float = 0.15
    w_external_noise: float = 0.10
    alert_thresh: float = 0.30
    min_flow_for_scoring: float | None = None
    global_susp_threshold: float = 0.45
    top_k_export: int = 50
    size_penalty_gamma: float = 0.05
    weighted: bool = False
    seed: int = 42
