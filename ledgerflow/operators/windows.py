"""Integer step windows as a column: all windows of a table in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filter_window(df: DataFrame, first: int, last: int, step: str = "step") -> DataFrame:
    """Rows with a step from first to last, both included; reaches the scan."""
    return df.where(F.col(step).between(first, last))


def assign_windows(df: DataFrame, size: int = 30, stride: int = 15, step: str = "step", origin: Column | None = None) -> DataFrame:
    """A row for each window that covers it, with window_index, step_start, step_end.

    Windows start at the least step and every stride after it, up to the largest step; a size under the stride leaves
    gaps, and rows in gaps have no window.  Empty windows have no rows.
    """
    if origin is None:
        origin = df.select(F.min(step).alias("o")).scalar()
    since = F.col(step) - F.col("__origin")
    lo = F.greatest(F.lit(0), F.ceil((since - (size - 1)) / F.lit(stride)).cast("int"))
    hi = F.floor(since / F.lit(stride)).cast("int")
    rows = df.withColumn("__origin", origin).where(lo <= hi)
    out = rows.withColumn("window_index", F.explode(F.sequence(lo, hi)))
    start = F.col("__origin") + F.col("window_index") * stride
    return out.withColumn("step_start", start.cast("int")).withColumn("step_end", (start + (size - 1)).cast("int")).drop("__origin")


def number_windows(df: DataFrame) -> DataFrame:
    """df with window_id: the place of its window among those with rows.  Windows are numbered in a table of their own."""
    seen = df.select("window_index").distinct()
    numbered = seen.withColumn("window_id", (F.row_number().over(Window.orderBy("window_index")) - 1).cast("int"))
    return df.join(numbered, "window_index")


def chunk_windows(df: DataFrame, size: int = 7, look_back: int = 2, step: str = "step") -> DataFrame:
    """Tumbling chunks that also hold the look_back steps before them: chunk_start, chunk_end and in_chunk (false for
    looked-back rows)."""
    origin = df.select(F.min(step).alias("o")).scalar()
    rows = df.withColumn("__origin", origin)
    own = F.floor((F.col(step) - F.col("__origin")) / F.lit(size)).cast("int")
    until = F.floor((F.col(step) - F.col("__origin") + look_back) / F.lit(size)).cast("int")
    rows = rows.withColumn("__own", own).withColumn("__chunk", F.explode(F.sequence(own, until)))
    start = F.col("__origin") + F.col("__chunk") * size
    last = df.select(F.max(step).alias("m")).scalar()
    return (
        rows.withColumn("chunk_start", start.cast("int")).withColumn("chunk_end", (start + size - 1).cast("int")).withColumn("in_chunk", F.col("__chunk") == F.col("__own"))
        .where(F.col("chunk_start") <= last).drop("__origin", "__own", "__chunk")
    )
