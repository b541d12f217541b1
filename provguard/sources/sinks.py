"""Sinks and materialisation.

Written tables go under the shared checkpoint folder (``scratch_path``) or a
path the caller names; nothing is written to a machine-local folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from provguard.session import ensure_checkpoint_dir, scratch_path


def write_csv(df: DataFrame, path: str, header: bool = True, null_text: str = "",
              compression: str | None = None, mode: str = "overwrite") -> str:
    """CSV with a header and no row names; nulls as ``null_text``."""
    w = df.write.mode(mode).option("header", header).option("nullValue", null_text)
    if compression:
        w = w.option("compression", compression)
    w.csv(path)
    return path


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] | None = None,
                  mode: str = "overwrite") -> str:
    """Parquet, optionally partitioned (e.g. by claim year for pruning)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def roundtrip_parquet(spark: SparkSession, df: DataFrame, name: str,
                      partition_by: Sequence[str] | None = None) -> DataFrame:
    """Write to a fresh shared location and read back (cuts lineage)."""
    path = write_parquet(df, scratch_path(spark, name), partition_by)
    return spark.read.parquet(path)


def materialise(df: DataFrame, view: str | None = None,
                level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
    """Keep an intermediate (``compute()``): persist and optionally name it."""
    out = df.persist(level)
    if view:
        out.createOrReplaceTempView(view)
    return out
