"""The corpus pipeline: each stage applies one operator to all documents that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerflow.llm.stages import STAGES
from ledgerflow.llm.store import new_path

#: Language identification, packing and learned models have no SQL; tests check stages, not run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's rows are written as Parquet in the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path := new_path(spark, f"stage-{name}"))
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
