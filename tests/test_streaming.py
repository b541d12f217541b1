"""Screening stream: arriving claim files labelled against the exclusion list."""

import os

from pyspark.sql import types as T

from provguard.sources import sinks
from provguard.streaming import screening


def test_screening_stream_available_now(spark, tmp_base):
    schema = T.StructType([T.StructField("rndrng_npi", T.StringType()),
                           T.StructField("hcpcs_cd", T.StringType())])
    src = os.path.join(tmp_base, "stream-in")
    out = os.path.join(tmp_base, "stream-out")
    sinks.write_parquet(spark.createDataFrame([("1", "a"), ("2", "b")], schema), src + "/b1")
    sinks.write_parquet(spark.createDataFrame([("3", "c"), ("1", "d")], schema), src + "/b2")
    listed = spark.createDataFrame([("1",), ("1",), (None,)], "npi string")
    stream = screening.claim_stream(spark, src + "/*", schema)
    q = screening.start_screening(spark, src + "/*", schema, listed, out,
                                  checkpoint=os.path.join(tmp_base, "stream-ckpt"))
    q.awaitTermination(120)
    assert stream.isStreaming
    got = sorted((r.rndrng_npi, r.hcpcs_cd, r.fraud) for r in spark.read.parquet(out).collect())
    assert got == [("1", "a", "yes"), ("1", "d", "yes"), ("2", "b", "no"), ("3", "c", "no")]
