"""Connected components of an edge table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_scratch


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (v, label): the smallest vertex that each linked vertex can reach.

    A round takes the least label among neighbours and then the label's own label, so paths
    shrink by half or better.  Labels are written to the shared folder after each round."""
    both = write_scratch(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "links")
    label = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("label")).withColumnRenamed("a", "v")
    label = write_scratch(label, "labels")
    while True:
        near = both.join(label, F.col("b") == F.col("v")).groupBy("a").agg(F.min("label").alias("near"))
        step = label.join(near, F.col("v") == F.col("a")).select("v", "label", F.least("label", "near").alias("low"))
        jump = step.select(F.col("v").alias("j"), F.col("low").alias("jump"))
        moved = write_scratch(step.join(jump, F.col("low") == F.col("j"), "left")
                              .select("v", "label", F.coalesce(F.least("low", "jump"), F.col("low")).alias("low")), "labels")
        if not moved.where("label <> low").limit(1).collect():
            return label
        label = moved.select("v", F.col("low").alias("label"))
