"""Node dictionaries: raw labels to contiguous ids that never change once given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import numbered


def fit(df: DataFrame, columns: tuple[str, ...] = ("src_node", "dst_node"), known: DataFrame | None = None) -> DataFrame:
    """raw_id, node_id: the sorted distinct labels of the columns; labels of `known` keep their ids and new ones follow."""
    values = None
    for c in columns:
        one = df.select(F.col(f"`{c}`").alias("raw_id"))
        values = one if values is None else values.unionByName(one)
    values = values.where("raw_id is not null").distinct()
    if known is None:
        return numbered(values, ("raw_id",), "node_id")
    new = values.join(known, "raw_id", "left_anti")
    return known.select("raw_id", "node_id").unionByName(numbered(new, ("raw_id",), "node_id", known.count()))


def transform(df: DataFrame, dictionary: DataFrame, columns: tuple[str, ...] = ("src_node", "dst_node"), strict: bool = True) -> DataFrame:
    """df with its labels replaced by ids.  strict: a label that isn't in the dictionary raises KeyError (one look)."""
    if strict:
        for c in columns:
            unseen = df.select(F.col(f"`{c}`").alias("raw_id")).where("raw_id is not null").distinct().join(dictionary, "raw_id", "left_anti").limit(5).collect()
            if unseen:
                raise KeyError(f"{c} has labels that were never fitted: {[r[0] for r in unseen]}")
    out = df
    for c in columns:
        d = dictionary.select(F.col("raw_id").alias("__raw"), F.col("node_id").alias("__id"))
        out = out.join(d, F.col(f"`{c}`") == F.col("__raw"), "left").withColumn(c, F.col("__id")).drop("__raw", "__id")
    return out.select(*df.columns)


def fit_transform(df: DataFrame, columns: tuple[str, ...] = ("src_node", "dst_node"), known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    dictionary = fit(df, columns, known)
    return transform(df, dictionary, columns, strict=False), dictionary


def encode_column(df: DataFrame, column: str, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One column encoded, its new labels registered."""
    return fit_transform(df, (column,), known)


def decode(df: DataFrame, dictionary: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """df with ids replaced by labels as text; an id without a label stays itself."""
    d = dictionary.select(F.col("node_id").alias("__id"), F.col("raw_id").cast("string").alias("__raw"))
    named = df.join(d, F.col(f"`{column}`") == F.col("__id"), "left").withColumn(out or column, F.coalesce("__raw", F.col(f"`{column}`").cast("string")))
    return named.drop("__raw", "__id")


def contains(df: DataFrame, dictionary: DataFrame, column: str) -> DataFrame:
    """Rows whose label is in the dictionary."""
    return df.join(dictionary.select(F.col("raw_id").alias(column)), column, "left_semi")
