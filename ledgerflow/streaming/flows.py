"""Structured Streaming face of the edge operators (an extension: the batch operators are the reference semantics)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_stream(events: DataFrame, size: str = "30 days", slide: str = "15 days", late: str = "1 day") -> DataFrame:
    """Snapshot edges of sliding event-time windows of a stream with ts, src_node, dst_node, amount; rows later than
    `late` are dropped by the watermark."""
    rows = events.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", size, slide), "src_node", "dst_node").agg(F.sum("amount").alias("weight"), F.count("*").alias("tx_count"), F.min("ts").alias("ts_min"), F.max("ts").alias("ts_max"))


def relay_stream(events: DataFrame, delta: str = "5 days", late: str = "1 day") -> DataFrame:
    """Pairs of transactions of which the second leaves the node that the first reached, within delta: a stream-stream
    interval join whose state is bounded by watermark and interval."""
    names = ("ts", "src_node", "dst_node", "amount")
    first = events.withWatermark("ts", late).select(*(F.col(c).alias(f"{c}_1") for c in names))
    second = events.withWatermark("ts", late).select(*(F.col(c).alias(f"{c}_2") for c in names))
    return first.join(second, F.expr(f"dst_node_1 = src_node_2 AND ts_2 > ts_1 AND ts_2 <= ts_1 + INTERVAL {delta}"))
