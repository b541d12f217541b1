"""Sparse feature vectors for any number of codes, without a wide pivot.

A code's place in the vector is its dense index, given by a distributed sort of the distinct codes
(the driver learns their number only).  Rows (key, code, value) join the index by code and gather by
key into one sparse vector each; absent codes are absent, as zeros are in the pivot.  All of it is
built-in expressions: the vector is read from its JSON form by Spark's own reader of the vector type.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provguard.operators.windows import row_ids

_VECTOR = T.StructType([T.StructField("v", VectorUDT())])


def code_index(df: DataFrame, code: str, name: str = "index") -> DataFrame:
    """(code, index): every distinct non-null code with its place from 0 in sorted order."""
    codes = df.select(F.col(code).cast("string").alias("code")).where(F.col("code").isNotNull()).distinct()
    return row_ids(codes, ["code"], "_id").select("code", (F.col("_id") - 1).cast("int").alias(name))


def vector_column(size: int, entries: Column) -> Column:
    """A sparse vector from an array of (index, value) structs with distinct indexes."""
    held = F.array_sort(F.filter(entries, lambda e: e["value"].isNotNull() & (e["value"] != 0)))
    parts = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
                     F.transform(held, lambda e: e["index"]).alias("indices"),
                     F.transform(held, lambda e: e["value"]).alias("values"))
    return F.from_json(F.to_json(F.struct(parts.alias("v"))), _VECTOR)["v"]


def sparse_vectors(long: DataFrame, keys: Sequence[str], code: str, value: str, index: DataFrame, size: int,
                   name: str = "codes") -> DataFrame:
    """(*keys, name): one sparse vector of ``size`` for each key from rows (keys, code, value).

    Codes that the index lacks are left out (as columns outside a pivot's list are); a key without any
    code gets the empty vector.  (key, code) is unique in ``long``, as ``long_agg`` gives it."""
    at = index.select(F.col("code").alias("_code"), F.col("index").alias("_at"))
    rows = long.join(at, F.col(code).cast("string") == F.col("_code"), "left")
    entry = F.when(F.col("_at").isNotNull(), F.struct(F.col("_at").alias("index"), F.col(value).cast("double").alias("value")))
    return rows.groupBy(*keys).agg(F.collect_list(entry).alias("_entries")).select(
        *keys, vector_column(size, F.col("_entries")).alias(name, metadata={"ml_attr": {"num_attrs": size}}))


def vector_entries(vector: str) -> Column:
    """(index, value) structs of a sparse vector column."""
    v = F.unwrap_udt(F.col(vector))
    return F.arrays_zip(v["indices"].alias("index"), v["values"].alias("value"))
