"""Written intermediate tables in the shared checkpoint folder.

Writing a table and reading it back cuts lineage (a lost executor re-reads
files instead of recomputing joins) and lets later queries scan only the
columns they need.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketlens.session import scratch_path


def materialize(spark: SparkSession, df: DataFrame, name: str,
                partition_by: list[str] | None = None) -> DataFrame:
    path = scratch_path(spark, name)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.parquet(path)
