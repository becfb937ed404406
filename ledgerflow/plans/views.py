"""Transaction views over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import ranged
from ..sources.transactions import elapsed_days, normalize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, src_node, dst_node, amount, step, is_sar: each event pays the user of the next one in (ts, event_id).

    "Next" is found inside a range of that order, and for a range's last event in the table of ranges.
    """
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    events = ranged(events.withColumn("step", elapsed_days(events, "ts")), "ts", "event_id")
    heads = events.where("__place = 0").select("__part", F.col("user_id").alias("first"))
    heads = heads.select("__part", F.lead("first").over(Window.orderBy("__part")).alias("next_range"))  # a row a range
    rows = events.withColumn("next", F.lead("user_id").over(Window.partitionBy("__part").orderBy("__place"))).join(heads, "__part")
    rows = rows.select("event_id", F.col("user_id").alias("src_node"), F.coalesce("next", "next_range").alias("dst_node"), F.col("value").alias("amount"), "step", (F.col("event_type") == "error").cast("int").alias("is_sar"))
    return rows.where((F.col("src_node") != F.col("dst_node")) & (F.col("amount") > 0))


def order_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw-named transactions from customers to parts, normalised: sparse, over years."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_shipdate", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    raw = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("nameOrig"), F.col("l_partkey").alias("nameDest"), F.col("l_extendedprice").alias("amount"), F.col("l_shipdate").cast("timestamp").alias("Timestamp"), (F.col("l_returnflag") == "R").cast("int").alias("isSAR")
    )
    return normalize(raw)
