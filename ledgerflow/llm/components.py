"""Connected components of a table of links, by alternating large-star and small-star steps.

Minima come from partial aggregation and are joined back as a written table, so that a node with very many links is
split by adaptive execution; every step is a written table in the shared folder, so a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

MAX_STEPS = 60


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node sends its larger (large) or smaller neighbours to the least node of its neighbourhood."""
    both = edges.select(F.col("u").alias("c"), F.col("v").alias("o")).unionByName(edges.select(F.col("v").alias("c"), F.col("u").alias("o")))
    if not large:
        both = edges.select(F.greatest("u", "v").alias("c"), F.least("u", "v").alias("o"))
    least = written(both.groupBy("c").agg(F.least(F.min("o"), F.first("c")).alias("m")), "least")
    joined = both.join(least, "c")
    if large:
        moved = joined.where("o > c").select(F.col("o").alias("u"), F.col("m").alias("v"))
        return moved.where("u <> v").distinct()
    own = least.select(F.col("c").alias("u"), F.col("m").alias("v"))
    return joined.select(F.col("o").alias("u"), F.col("m").alias("v")).unionByName(own).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, label of every node of links (u, v): label is the least node that links lead to.  Loops are ignored."""
    edges = written(links.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).where("u <> v").select("u", "v").distinct(), "edges")

    if edges.isEmpty():
        return written(edges.select(F.col("u").alias("node"), F.col("v").alias("label")), "labels")
    for _ in range(MAX_STEPS):
        now = written(_stars(written(_stars(edges, True), "large"), False), "small")
        same = now.count() == edges.count() and now.join(edges, ["u", "v"], "left_anti").isEmpty()  # both have distinct rows
        edges = now
        if same:
            break
    else:
        raise RuntimeError("components didn't settle")
    return written(edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct(), "labels")
