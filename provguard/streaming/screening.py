"""Screening newly arriving claim files against the exclusion list.

The study notes that the list changes monthly and providers should be
screened monthly.  This is the label join (J04) on a file stream: claim
files landing in a folder are read incrementally, joined to the distinct
excluded NPIs (a static, size-checked broadcast side; stream-static left
outer join needs no state), and appended to a Parquet sink.  Progress lives
in a checkpoint under the shared checkpoint folder, so a restarted or
failed query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from provguard.operators.joins import label_by_membership
from provguard.session import scratch_path


def claim_stream(spark: SparkSession, path: str, schema: T.StructType,
                 fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """Incremental reader over a folder of claim files (schema required)."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def screen(stream: DataFrame, excluded: DataFrame, key: str = "rndrng_npi",
           list_key: str = "npi", label: str = "fraud") -> DataFrame:
    """Label each arriving claim line ``yes`` / ``no`` by list membership."""
    return label_by_membership(stream, excluded, key, list_key, label, "yes", "no")


def start_screening(spark: SparkSession, claims_path: str, schema: T.StructType,
                    excluded: DataFrame, out_path: str, checkpoint: str | None = None,
                    fmt: str = "parquet", available_now: bool = True) -> StreamingQuery:
    """Run the screening stream into ``out_path`` (append mode)."""
    labelled = screen(claim_stream(spark, claims_path, schema, fmt), excluded)
    writer = (labelled.writeStream.format("parquet").outputMode("append")
              .option("path", out_path)
              .option("checkpointLocation", checkpoint or scratch_path(spark, "screening-ckpt")))
    writer = writer.trigger(availableNow=True) if available_now else \
        writer.trigger(processingTime="1 minute")
    return writer.start()
