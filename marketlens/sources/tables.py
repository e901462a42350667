"""Reading the driver's parquet tables.

Every reader returns a lazy DataFrame; column pruning and predicate pushdown
reach the parquet scan because nothing here selects ``*`` eagerly.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    return spark.read.parquet(table_path(sf_dir, name))


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Expose every table as a temp view (for ``spark.sql`` users)."""
    for name in TABLES:
        load_table(spark, sf_dir, name).createOrReplaceTempView(name)
