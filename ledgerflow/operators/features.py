"""Feature tables of motif instances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MOTIFS

# Metrics of the wide table, in its order.
WIDE_METRICS = ("count", "avg_amount", "avg_ratio", "ratio_std", "avg_lag", "max_lag", "avg_n_alert_edges", "zscore", "freq_by_degree", "freq_by_volume")


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(a)


#: Whole numbers under it are the same as a double and as a bigint.
_SURE = 2.0**53
_PARTS = ("high", "low", "wide", "other")


def _with_parts(df: DataFrame, places: dict[str, int]) -> DataFrame:
    """df with each column of `places`, rounded to so many places, as a whole number in parts: high and low bits of a usual
    one, a decimal and the value itself of any other.  Their sums by group are narrow rows that compress well."""
    cols = {}
    for name, n in places.items():
        whole = F.round(F.col(name) * 10**n)
        usual, other = F.abs(whole) < _SURE, F.abs(whole) >= _SURE  # not a number is larger than any
        bits = F.when(usual, whole).cast("bigint")
        cols |= {f"{name}_high": F.shiftright(bits, 30), f"{name}_low": bits.bitwiseAND(F.lit((1 << 30) - 1))}
        cols |= {f"{name}_wide": F.when(other, whole).try_cast("decimal(38,0)"), f"{name}_other": F.when(other, F.col(name).cast("double"))}
    return df.withColumns(cols)


def _exact_mean(name: str, places: int) -> Column:
    """Mean over a group of values rounded to so many places, of rows of _with_parts(): a sum of whole numbers, so no order
    of adding changes it.  A group with a value too large for 38 digits, or not a number, has the plain mean."""
    high, low, wide, other = (F.col(f"{name}_{p}") for p in _PARTS)
    part = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("decimal(20,0)")
    usual = (part(high) * F.lit(1 << 30) + part(low)).cast("decimal(38,0)")
    n = (F.count(high) + F.count(other)).cast("double")
    whole = F.when(F.count(other) == 0, usual).when(F.count(wide) == F.count(other), F.try_add(usual, F.try_sum(wide)))
    plain = F.try_divide(usual.cast("double") / 10**places + F.sum(other), n)
    return F.coalesce(F.try_divide(whole.cast("double"), n * 10**places), plain)


def instance_stats(found: DataFrame) -> DataFrame:
    """found with avg_amount, avg_ratio, ratio_std (of the population), avg_lag, max_lag; ratios of no edge are null."""
    some = F.size("ratios") > 0
    mean = F.when(some, _mean(F.col("ratios")))
    rows = found.withColumn("avg_ratio", mean)
    square = F.aggregate("ratios", F.lit(0.0), lambda s, x: s + (x - F.col("avg_ratio")) * (x - F.col("avg_ratio")))
    return (
        rows.withColumn("avg_amount", F.when(F.size("amounts") > 0, _mean(F.col("amounts"))).otherwise(F.lit(0.0)))
        .withColumn("ratio_std", F.when(some, F.sqrt(square / F.size("ratios"))))
        .withColumn("avg_lag", F.when(F.size("lags") > 0, _mean(F.col("lags"))).otherwise(F.lit(0.0)))
        .withColumn("max_lag", F.when(F.size("lags") > 0, F.array_max("lags").cast("double")).otherwise(F.lit(0.0)))
    )


def entity_features(found: DataFrame, zscores: DataFrame | None = None, node_degree: DataFrame | None = None, total_volume: float | Column | None = None) -> DataFrame:
    """(node, motif_type) with counts and means over its instances, zscore of the type, and counts by degree and volume.

    node_degree: node, degree (missing: 1); without it freq_by_degree is 0, and freq_by_volume without a volume over 0.
    """
    places = {"avg_amount": 6, "avg_ratio": 9, "ratio_std": 9, "avg_lag": 9}
    rows = _with_parts(instance_stats(found), places).withColumn("node", F.explode(F.array_distinct("nodes")))
    out = rows.groupBy("node", "motif_type").agg(
        F.count("*").alias("count"), *(_exact_mean(c, n).alias(c) for c, n in places.items()),
        F.max("max_lag").alias("max_lag"), F.avg(F.col("n_alert").cast("bigint")).alias("avg_n_alert_edges"),
    )
    out = out.join(zscores.select("motif_type", "zscore"), "motif_type", "left") if zscores is not None else out.withColumn("zscore", F.lit(None).cast("double"))
    if node_degree is not None:
        out = out.join(node_degree.select("node", "degree"), "node", "left").withColumn("freq_by_degree", F.col("count") / F.coalesce("degree", F.lit(1)))
    else:
        out = out.withColumn("freq_by_degree", F.lit(0.0))
    volume = total_volume if isinstance(total_volume, Column) else F.lit(float(total_volume or 0.0))
    out = out.withColumn("freq_by_volume", F.when(volume > 0, F.col("count") / volume).otherwise(F.lit(0.0)))
    return out.select("node", "motif_type", *WIDE_METRICS)


def entity_wide(entity: DataFrame, motifs: tuple[str, ...] = MOTIFS) -> DataFrame:
    """A row a node with {motif}_{metric} for every type and metric; what is missing is 0."""
    wide = entity.groupBy("node").pivot("motif_type", list(motifs)).agg(*(F.first(m).alias(m) for m in WIDE_METRICS))
    return wide.na.fill(0)


def window_features(found: DataFrame, window_size: int = 7) -> DataFrame:
    """(window_start, motif_type): instances by the bucket of their first step, buckets from 0."""
    rows = _with_parts(instance_stats(found.where(F.size("steps") > 0)), {"avg_lag": 9})
    start = (F.floor(F.array_min("steps") / F.lit(window_size)) * window_size).cast("int")
    total = F.aggregate("amounts", F.lit(0.0), lambda s, x: s + x)
    return rows.select(start.alias("window_start"), "motif_type", total.alias("t"), *(f"avg_lag_{p}" for p in _PARTS), "n_alert").groupBy("window_start", "motif_type").agg(
        F.count("*").alias("count"), F.sum("t").alias("total_amount"), _exact_mean("avg_lag", 9).alias("avg_lag"), F.sum("n_alert").alias("n_alert_edges"), F.avg((F.col("n_alert") > 0).cast("int")).alias("suspicious_ratio")
    )


def node_degrees(df: DataFrame) -> DataFrame:
    """node, degree: events that leave it."""
    return df.groupBy(F.col("src_node").alias("node")).agg(F.count("*").alias("degree"))
