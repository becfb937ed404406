"""Writing result tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def save_table(df: DataFrame, name: str, folder: str = "outputs/motif_features", fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> str:
    """Writes df under folder/name and returns the path.  fmt is parquet or csv (with a header)."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"format {fmt}: parquet or csv")
    path = f"{folder}/{name}"
    writer = df.write.mode("overwrite")
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    writer.parquet(path) if fmt == "parquet" else writer.option("header", True).csv(path)
    return path


def save_all(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> dict[str, str]:
    """Writes each table that has rows; returns the paths of those."""
    return {name: save_table(df, name, folder, fmt) for name, df in tables.items() if df is not None and not df.isEmpty()}


def save_report(df: DataFrame, path: str, most: int = 100_000) -> str:
    """A small table (a report, a row a motif type or so) as one JSON object of its first column to the others, written
    through Spark.  All rows are written: a table of more than `most` rows, or with one value in the first column twice,
    raises a ValueError and writes nothing."""
    first, *rest = df.columns
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: save it as a table")
    report = {str(r[first]): {c: r[c] for c in rest} for r in rows}
    if len(report) < len(rows):
        raise ValueError(f"{first} has a value in several rows")
    return save_json(df.sparkSession, report, path)


def save_json(spark: SparkSession, report: dict, path: str) -> str:
    text = json.dumps(report, default=str, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path
