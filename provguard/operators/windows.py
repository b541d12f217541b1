"""Rank, order, lump, z-score and row ids.

Global orderings are only taken over grouped rows (one row per level), whose
number is bounded by the category count.  Row ids over a whole table use
range partitioning plus per-partition offsets, never a single-task window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provguard.session import ensure_checkpoint_dir, input_bytes

RANGE_BYTES = 256 << 20  # bytes of the tables read for each range of row ids


def ordinal(grouped: DataFrame, order: Sequence[Column], name: str = "order") -> DataFrame:
    """1..n over sorted grouped rows (``mutate(order = 1:n)``)."""
    return grouped.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def level_order(grouped: DataFrame, by: str, name: str | None = None,
                descending: bool = False) -> DataFrame:
    """Integer order of levels by a value (``fct_reorder``); ties share a rank."""
    v = F.col(by)
    o = [v.desc() if descending else v.asc()]
    rank = F.dense_rank().over(Window.orderBy(*o)).cast("long")
    return grouped.withColumn(name or f"{by}_ord", rank)


def lump_top_n(df: DataFrame, column: str, n: int, other: str = "Other",
               name: str | None = None) -> DataFrame:
    """Keep the ``n`` most frequent levels, others become ``other``; null stays null.

    Counts are taken over all rows of ``df`` (before any later filter); ties at the n-th
    count all stay.  If at most one level would be lumped, nothing is lumped.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    top = counts.orderBy(F.col("_n").desc()).limit(n)  # planned as take-ordered
    least = top.agg(F.min("_n")).scalar()
    n_lumped = counts.agg(F.count_if(F.col("_n") < least)).scalar()
    keep = (counts.where((F.col("_n") >= least) | (n_lumped <= 1))
            .select(F.col(column).alias("_lvl"), F.lit(True).alias("_keep")))
    # One row per kept level; adaptive execution broadcasts it at run time.
    out = df.join(keep, df[column] == keep["_lvl"], "left")
    c = F.col(column)
    lumped = F.when(c.isNull(), F.lit(None)).when(F.col("_keep"), c).otherwise(F.lit(other))
    return out.withColumn(name or column, lumped).drop("_lvl", "_keep")


def zscore_by(df: DataFrame, partition: Sequence[str], value: str,
              name: str = "z") -> DataFrame:
    """``(v - mean) / sd`` within each partition (sample sd; sd 0 gives null)."""
    w = Window.partitionBy(*partition)
    v = F.col(value).cast("double")
    sd = F.stddev_samp(v).over(w)
    return df.withColumn(name, F.try_divide(v - F.avg(v).over(w), sd))


def sorted_parts(df: DataFrame, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Rows range-partitioned and sorted by ``order``, with ``_pid`` and ``_mono`` fixed.

    Range boundaries are sampled per job, so the tagged rows are written once with a
    reliable checkpoint (shared checkpoint folder): all later passes see the same
    partitions, and a lost executor cannot renumber rows."""
    ensure_checkpoint_dir(df.sparkSession)
    n = partitions or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                          input_bytes(df) // RANGE_BYTES)
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return ranged.withColumns({"_pid": F.spark_partition_id(),
                               "_mono": F.monotonically_increasing_id()}).checkpoint(eager=True)


def row_ids(df: DataFrame, order: Sequence[str], name: str = "row_id",
            partitions: int | None = None) -> DataFrame:
    """Sequential ids 1..n in the order of ``order``, computed in parallel.

    Each sorted part's size is counted (one row per partition), turned into a running
    offset, and broadcast back.  The id is offset + position within the partition.  Give a
    total order (unique key, or all columns) for a deterministic result.
    """
    # A row hash after the order keys splits long runs of equal keys across
    # range partitions; it only orders rows the caller's keys leave tied.
    keyed = df.withColumn("_tie", F.xxhash64(*[F.col(c) for c in df.columns]))
    tagged = sorted_parts(keyed, [*order, "_tie"], partitions)
    sizes = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    # One row per partition: a proven bound, so the broadcast is safe.
    out = tagged.join(F.broadcast(offsets), "_pid")
    local = F.col("_mono") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (out.withColumn(name, F.col("_off") + local + F.lit(1))
            .drop("_pid", "_mono", "_off", "_tie"))
