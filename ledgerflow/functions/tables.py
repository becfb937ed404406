"""Tables written once: cutting the lineage of loops, and numbering rows in an order without a sort in one task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = "spark.checkpoint.dir"


def _folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session (a temporary folder only where that is unset and local)."""
    context = spark.sparkContext
    found = spark.conf.get(KEY, None) or context.getConf().get(KEY, None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError(f"set {KEY} to a folder that all executors share")
        if not (found := getattr(spark, "_own_folder", None)):
            found = spark._own_folder = "file://" + tempfile.mkdtemp(prefix="tables-")
    return found.rstrip("/")


def cores(spark: SparkSession) -> int:
    """Tasks that run side by side: a table that much is made of has as many files at least."""
    return max(1, spark.sparkContext.defaultParallelism)


def settled(df: DataFrame, *by: str) -> DataFrame:
    """df as a table in the shared folder, computed once and reread: it outlives executors, and plans above it are short.

    by: columns by which rows are dealt to a file for each core at least, however few bytes they are: for tables that
    are small and of which much is made.
    """
    if getattr(df, "_settled", False):
        return df
    spark = df.sparkSession
    path = f"{_folder(spark)}/settled-{uuid.uuid4().hex}"
    rows = df.repartition(cores(spark), *(F.col(f"`{c}`") for c in by)) if by else df
    rows.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = True
    spark.__dict__.setdefault("_settled_paths", []).append(path)
    return out


#: Rows that a task gets, about, of a table of which parts() tells the tasks.
PART_ROWS = 100_000


def parts(df: DataFrame) -> int:
    """Tasks for a step that makes much of each row of df: a core each at least, more the more rows there are.  df is
    counted, so it should be a written table."""
    return max(cores(df.sparkSession), -(-df.count() // PART_ROWS))


def _delete(spark: SparkSession, paths: list[str]) -> int:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    return len(paths)


def clear(spark: SparkSession) -> int:
    """Deletes all tables that this session has settled, for a caller that is done with what was made of them; returns
    their number."""
    return _delete(spark, spark.__dict__.pop("_settled_paths", []))


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables settled inside are deleted at the end: for a step whose results the caller holds by then."""
    paths = spark.__dict__.setdefault("_settled_paths", [])
    kept = len(paths)
    try:
        yield
    finally:
        _delete(spark, paths[kept:])
        del paths[kept:]


def side_by_side(f: Callable, items: Iterable) -> list:
    """f of each item, all begun at once, for work whose small jobs wait for each other: cores that one leaves idle take
    tasks of another.  An error is raised when all have ended."""
    items = list(items)
    with ThreadPoolExecutor(max(1, len(items))) as threads:
        return list(threads.map(f, items))


def ranged(df: DataFrame, *order: str, keep: tuple[str, ...] | None = None) -> DataFrame:
    """df, or its columns `keep`, dealt by ranges of the columns `order` and sorted, written once: __part numbers the ranges
    in ascending order, __place the rows of a range from 0."""
    cols = [F.col(f"`{c}`") for c in order]
    rows = df.repartitionByRange(cores(df.sparkSession), *cols).sortWithinPartitions(*cols).withColumn("__part", F.spark_partition_id())
    rows = rows.withColumn("__place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    return settled(rows if keep is None else rows.select(*keep, "__part", "__place"))


def numbered(df: DataFrame, order: tuple[str, ...], name: str, start: Column | int = 0, keep: tuple[str, ...] | None = None) -> DataFrame:
    """df, or its columns `keep`, with the column `name`: `start` and up in the order of the columns `order`.

    Offsets of ranges come from the same written table as the places in them, so ids have no gaps or doubles.
    """
    rows = ranged(df, *order, keep=keep)
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    first = sizes.select("__part", (F.coalesce(before, F.lit(0)) + start).alias("__first"))
    return rows.join(first, "__part").select(*(F.col(f"`{c}`") for c in keep or df.columns), (F.col("__first") + F.col("__place")).cast("bigint").alias(name))
