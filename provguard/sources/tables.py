"""Parquet tables (the driver's test data and any Parquet claims store)."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def table_path(base: str, name: str) -> str:
    return os.path.join(base, f"{name}.parquet")


def read_table(spark: SparkSession, base: str, name: str,
               columns: Sequence[str] | None = None) -> DataFrame:
    """Read one Parquet table; a column list is pruned at the scan."""
    df = spark.read.parquet(table_path(base, name))
    return df.select(*columns) if columns else df
