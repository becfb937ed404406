"""Edge tables: relay pairs, snapshots, second-order edges, adjacency, degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import parts, settled


def _labelled(df: DataFrame) -> DataFrame:
    return df if "is_sar" in df.columns else df.withColumn("is_sar", F.lit(0))


def temporal_edges(df: DataFrame, delta_w: int = 5, keys: tuple[str, ...] = (), bucketed: bool = False) -> DataFrame:
    """Pairs of transactions where the second leaves, 1 to delta_w steps later, the node that the first reached.

    `bucketed` adds the step divided by delta_w + 1 to the join key: for nodes with so many transactions that all pairs
    of one node would be too much for a task.  The result is the same.

    The number of tasks grows with the events, so that what a task makes of its pairs (second-order edges) doesn't.
    """
    df = settled(_labelled(df).select(*keys, "src_node", "dst_node", "step", "amount", "is_sar"))
    names = {"src_node": "src", "dst_node": "dst", "step": "step", "amount": "amount", "is_sar": "alert"}
    first, second = (df.select(*keys, *(F.col(c).alias(f"{n}_{i}") for c, n in names.items())) for i in (1, 2))
    on = [*keys]
    if bucketed:
        first = first.withColumn("__b", F.explode(F.array(F.floor(F.col("step_1") / F.lit(delta_w + 1)), F.floor(F.col("step_1") / F.lit(delta_w + 1)) + 1)))
        second = second.withColumn("__b", F.floor(F.col("step_2") / F.lit(delta_w + 1)))
        on.append("__b")
    first, second = first.withColumn("__n", F.col("dst_1")), second.withColumn("__n", F.col("src_2"))
    many, gap = parts(df), F.col("step_2") - F.col("step_1")
    first, second = (rows.repartition(many, *on, "__n") for rows in (first, second))
    joined = first.alias("a").join(second.alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*on, "__n"]] + [gap > 0, gap <= delta_w])
    return joined.select(*(F.col(f"a.{k}").alias(k) for k in keys), *(f"{n}_1" for n in names.values()), *(f"{n}_2" for n in names.values()))


def snapshot_edges(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(src_node, dst_node) with weight, tx_count, step_min, step_max."""
    return df.groupBy(*keys, "src_node", "dst_node").agg(F.sum("amount").alias("weight"), F.count("amount").alias("tx_count"), F.min("step").alias("step_min"), F.max("step").alias("step_max"))


def second_order_edges(relay: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """src_2nd, dst_2nd over relay pairs that don't return: count, weight_src, weight_dst, avg_gap, n_alert."""
    return (
        relay.where("src_1 <> dst_2").groupBy(*keys, F.col("src_1").alias("src_2nd"), F.col("dst_2").alias("dst_2nd"))
        .agg(
            F.count("*").alias("count"), F.sum("amount_1").alias("weight_src"), F.sum("amount_2").alias("weight_dst"),
            F.avg(F.col("step_2") - F.col("step_1")).alias("avg_gap"), F.sum(F.col("alert_1").cast("bigint") + F.col("alert_2").cast("bigint")).alias("n_alert"),
        )
    )


def adjacency(edges: DataFrame, keys: tuple[str, ...] = (), weight: str = "weight") -> DataFrame:
    """The sparse matrix as rows i, j, w; parallel edges add up."""
    return edges.groupBy(*keys, F.col("src_node").alias("i"), F.col("dst_node").alias("j")).agg(F.sum(weight).alias("w"))


def node_count(matrix: DataFrame) -> DataFrame:
    """One row: the largest node number and one more."""
    return matrix.agg((F.coalesce(F.max(F.greatest("i", "j")), F.lit(-1)) + 1).alias("n_nodes"))


def degrees(matrix: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """node, d_out, d_in: row and column sums in one aggregation."""
    ends = matrix.select(*keys, F.explode(F.array(F.struct(F.col("i").alias("node"), F.col("w").alias("o"), F.lit(0.0).alias("n")), F.struct(F.col("j").alias("node"), F.lit(0.0).alias("o"), F.col("w").alias("n")))).alias("e"))
    return ends.groupBy(*keys, F.col("e.node").alias("node")).agg(F.sum("e.o").alias("d_out"), F.sum("e.n").alias("d_in"))


def window_stats(matrix: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """m_t (total weight), n_edges, n_active (nodes with an edge) of each window."""
    total = matrix.groupBy(*keys).agg(F.sum("w").alias("m_t"), F.count("*").alias("n_edges"))
    active = active_nodes(matrix, keys).groupBy(*keys).agg(F.count("*").alias("n_active"))
    return total.join(active, list(keys)) if keys else total.crossJoin(active)  # without keys both are one row


def active_nodes(matrix: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return matrix.select(*keys, F.explode(F.array("i", "j")).alias("node")).distinct()


def symmetrize(matrix: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(A + transposed A) / 2."""
    both = matrix.select(*keys, F.explode(F.array(F.struct(F.col("i").alias("i"), F.col("j").alias("j")), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("e"), "w")
    return both.groupBy(*keys, F.col("e.i").alias("i"), F.col("e.j").alias("j")).agg((F.sum("w") / 2).alias("w"))


def relay_edges(df: DataFrame, keys: tuple[str, ...] = (), count_rows: bool = False) -> DataFrame:
    """(src_node, dst_node) with weight and tx_count: transactions if the table counts them, else (or count_rows) rows."""
    amount = "weight" if "weight" in df.columns else "amount"
    n = F.sum("tx_count") if "tx_count" in df.columns and not count_rows else F.count("*")
    return df.groupBy(*keys, "src_node", "dst_node").agg(F.sum(amount).alias("weight"), n.alias("tx_count"))
