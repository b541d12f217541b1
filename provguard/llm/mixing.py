"""Mixing sources to target weights by hash-random order and distributed prefix sums.

Each row gets a random but repeatable key (md5 of its id).  Rows of a source are
dealt into ranges of that key, the ranges' token sums give each range its start,
and a window inside one range finishes the prefix sums.  A source is cut at its
exact budget; a budget above the source's size goes through it again (epochs).

A hot source is no harder than others: its ranges are separate groups.  Only sums
for each (source, range) and one row for each source pass through small windows.

Defined cases: null text has size 0; a null source is a source of its own, ordered
last; rows with equal ids are ordered by size and text hash, so reruns agree; an empty
table gives no rows; a source of size 0 has target 0.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checked_columns

WEIGHTS = (3, 1, 2)


def source_targets(sizes: DataFrame, share: float, max_epochs: int,
                   weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> also ``target``: ``share`` of all sizes dealt by weight,
    none above ``max_epochs`` times its size, the excess shared out again by weight.

    The fixed point is one level: target = min(weight * level, cap).  Sources are ordered
    by cap / weight; the level that leaves the first k capped holds if it reaches the
    k-th ratio; the first such level is the largest of those that hold.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]),
                     ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * max_epochs)
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = (s.withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
          .withColumn("weight_left", F.sum("weight").over(everything)
                      - F.coalesce(F.sum("weight").over(before), F.lit(0)))
          .withColumn("total", F.sum("source_size").over(everything)))
    level = (F.col("total") * F.lit(float(share)) - F.col("capped_before")) / F.col("weight_left")
    s = s.withColumn("level", level)
    s = s.withColumn("holds", F.col("level") <= F.col("cap") / F.col("weight"))
    first = F.max(F.when(F.col("holds"), F.col("level"))).over(everything)
    return s.select("source", "source_size",
                    F.least(F.col("cap").cast("double"),
                            F.coalesce(F.col("weight") * first, F.col("cap").cast("double"))).alias("target"))


def mix_sources(docs: DataFrame, size: Column | None = None, share: float = 1.5, max_epochs: int = 2,
                weights: tuple[int, ...] = WEIGHTS, digits: int = 3) -> DataFrame:
    """Tokens taken from each row: (doc_id, size, source_size, target, taken).

    ``digits``: hex digits of the key that name a range (16**digits ranges a source).
    The row at the cut is taken in part, so each source meets its budget to the token.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) if size is None else size
    rows = checked_columns(docs, ["doc_id", "text", "source"]).select(
        "doc_id", "source", size.cast("long").alias("size"), F.md5(F.col("doc_id").cast("string")).alias("key"),
        F.xxhash64("text").alias("tie"))
    rows = rows.withColumn("range", F.substring(F.coalesce("key", F.lit("")), 1, digits))
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    starts = sums.withColumn("start", F.sum("range_size").over(
        Window.partitionBy("source").orderBy("range")) - F.col("range_size"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")),
                             share, max_epochs, weights)
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    plan = starts.join(t, F.col("source").eqNullSafe(F.col("t_source"))).select(
        F.col("source").alias("p_source"), F.col("range").alias("p_range"), "start", "source_size", "target")
    inside = Window.partitionBy("source", "range").orderBy(
        F.col("key").asc_nulls_first(), "doc_id", "size", "tie")
    rows = rows.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("range") == F.col("p_range")))
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - whole * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"),
                      F.least(F.col("size"), rest - (F.col("start") + F.col("upto") - F.col("size"))))
    return out.select("doc_id", "size", "source_size", "target", (whole * F.col("size") + part).alias("taken"))


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    from .common import read_table
    return mix_sources(read_table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5(doc_id::VARCHAR) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
             2 * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0))
             / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
      FROM w WINDOW b AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT max(level) AS level FROM l WHERE level <= cap::DOUBLE / weight),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(weight * (SELECT level FROM f), cap::DOUBLE)) AS target FROM l),
p AS (SELECT d.*, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
             (sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN (budget // source_size) * size
                  + greatest(0, least(size, budget % source_size - before)) ELSE 0 END)::BIGINT AS taken
FROM p
"""
