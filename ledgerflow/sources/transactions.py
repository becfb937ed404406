"""Reading transactions and bringing them to the canonical columns src_node, dst_node, amount, step, is_sar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import EVENT_ALIASES, LoadConfig
from ..functions.tables import numbered

DAY_MICROS = 86_400_000_000


def read_any(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Parquet if the path ends in .parquet, else CSV with a header.  A missing path raises PATH_NOT_FOUND."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def rename_known(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns under their canonical names; only those present."""
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns and k != v})


def elapsed_days(df: DataFrame, timestamp: str = "timestamp") -> Column:
    """Whole 24-hour periods since the first timestamp of df (not calendar days)."""
    micros = F.unix_micros(F.col(timestamp).cast("timestamp"))
    first = df.select(F.min(micros).alias("m"))
    return F.floor((micros - first.scalar()) / F.lit(DAY_MICROS)).cast("int")


def with_step(df: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    return df.withColumn("step", elapsed_days(df, timestamp))


def cast_known(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns cast to their types.  A column of which one non-null value can't be cast stays as it is: text labels of
    nodes pass through whole.  Columns that have their type, or a wider number, need no look at the data."""
    numbers = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    kinds = dict(df.dtypes)
    doubtful = [c for c, t in types.items() if c in kinds and kinds[c] != t and kinds[c] not in numbers and not kinds[c].startswith("decimal")]
    failed = set()
    if doubtful:
        bad = df.agg(*(F.max((F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(types[c]).isNull()).cast("int")).alias(str(i)) for i, c in enumerate(doubtful))).first()
        failed = {c for i, c in enumerate(doubtful) if bad[i]}
    return df.withColumns({c: F.col(f"`{c}`").try_cast(t) for c, t in types.items() if c in kinds and kinds[c] != t and c not in failed})


def normalize(df: DataFrame, cfg: LoadConfig = LoadConfig()) -> DataFrame:
    """Canonical transactions of a raw table: renamed, checked, with steps and labels, cast, without loops and amounts
    that are not over cfg.min_amount, null or NaN.  Rows without an endpoint go.  No order."""
    df = rename_known(df, cfg.names)
    if missing := [c for c in ("src_node", "dst_node", "amount") if c not in df.columns]:
        raise ValueError(f"mandatory columns missing: {missing}; found {df.columns}")
    if "step" not in df.columns:
        if "timestamp" not in df.columns:
            raise ValueError("neither step nor timestamp is there")
        df = with_step(df)
    if "is_sar" not in df.columns:
        df = df.withColumn("is_sar", F.lit(0).cast("tinyint"))
    df = cast_known(df, cfg.types)
    amount = F.col("amount")
    return df.where((F.col("src_node") != F.col("dst_node")) & (amount > cfg.min_amount) & ~F.isnan(amount)).select(*cfg.keep)


def load_transactions(spark: SparkSession, path: str, cfg: LoadConfig = LoadConfig(), schema=None) -> DataFrame:
    return normalize(read_any(spark, path, schema), cfg)


def event_columns(df: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """Event columns under canonical names: the caller's names first ({name: canonical}), then older aliases."""
    df = rename_known(df, overrides or {})
    for name, aliases in EVENT_ALIASES.items():
        if name not in df.columns and (found := [a for a in aliases if a in df.columns]):
            df = df.withColumnRenamed(found[0], name)
    if missing := [c for c in ("src_node", "dst_node", "step", "amount") if c not in df.columns]:
        raise ValueError(f"event columns missing: {missing}; found {df.columns}")
    return df if "is_sar" in df.columns else df.withColumn("is_sar", F.lit(0).cast("tinyint"))


def with_event_id(df: DataFrame) -> DataFrame:
    """event_id from 0 in the order of step and then all columns, where there is none yet.  Rows are sorted in ranges, so
    neither all rows nor those of one step come together in a task."""
    if "event_id" in df.columns:
        return df
    return numbered(df, ("step", *(c for c in df.columns if c != "step")), "event_id")


def check_ordered(df: DataFrame) -> DataFrame:
    """Raises if a later event_id has an earlier step: for callers that rely on ids being in time order."""
    steps = df.groupBy("step").agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    wrong = steps.withColumn("before", F.lag("hi").over(Window.orderBy("step"))).where("lo < before")
    if not wrong.isEmpty():
        raise ValueError("steps don't ascend with event_id")
    return df
