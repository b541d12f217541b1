"""A claim store: yearly claims written once, partitioned by year and bucketed by provider.

Monthly labelling joins the store with a list bucketed alike, so neither side is shuffled or sorted
again: each bucket's files are read in key order and merged.  Years prune as partitions.  New
years are appended with the same number of buckets.

A bucket of one very hot provider is one long task, but a streaming one (the list holds each key
once); where providers are that uneven, ``joins.label_by_membership`` spreads them at the price of a shuffle.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provguard.session import input_bytes

BUCKET_BYTES = 8 << 20  # of the tables that a frame reads, for each bucket


def bucket_count(df: DataFrame, least: int = 8) -> int:
    """Buckets for a store of ``df``: a task sorts a whole bucket, so their number grows with the tables read."""
    return max(least, math.ceil(input_bytes(df) / BUCKET_BYTES))


def table_name(name: str) -> str:
    return f"{name}_{uuid.uuid4().hex[:12]}"


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int, partition: str | None = None,
                   mode: str = "overwrite") -> DataFrame:
    """Write ``df`` as an external table of sorted buckets under ``path`` and read it.

    Rows are shuffled to their bucket first, so a bucket is one file for each partition value, not one for
    each task.  The catalog holds the layout: drop the table and the files remain, but without buckets."""
    w = (df.repartition(buckets, key).write.mode(mode).format("parquet").option("path", path)
         .bucketBy(buckets, key).sortBy(key))
    if partition:
        w = w.partitionBy(partition)
    w.saveAsTable(table)
    return df.sparkSession.table(table)


def write_claim_store(claims: DataFrame, table: str, path: str, key: str = "rndrng_npi", year: str = "year",
                      buckets: int = 64) -> DataFrame:
    """The stacked claims, one folder a year."""
    return write_bucketed(claims, table, path, key, buckets, year)


def append_year(spark: SparkSession, claims: DataFrame, table: str, path: str, key: str = "rndrng_npi", year: str = "year",
                buckets: int = 64) -> DataFrame:
    """Add another load; the bucket layout must be the table's."""
    write_bucketed(claims, table, path, key, buckets, year, mode="append")
    spark.catalog.refreshTable(table)
    return spark.table(table)


def write_member_store(members: DataFrame, table: str, path: str, key: str, buckets: int = 64) -> DataFrame:
    """The list's distinct non-null keys, bucketed like the claims."""
    keys = members.select(F.col(key).alias("member_key")).where(F.col("member_key").isNotNull()).distinct()
    return write_bucketed(keys, table, path, "member_key", buckets)


def label_from_store(claims: DataFrame, members: DataFrame, key: str = "rndrng_npi", label: str = "fraud",
                     yes: object = "yes", no: object = "no") -> DataFrame:
    """The existence label by a merge of the two stores' buckets."""
    hit = members.select("member_key", F.lit(True).alias("_hit"))
    out = claims.join(hit.hint("merge"), claims[key] == F.col("member_key"), "left")
    return out.withColumn(label, F.when(F.col("_hit"), F.lit(yes)).otherwise(F.lit(no))).drop("member_key", "_hit")
