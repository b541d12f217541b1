"""A corpus pipeline over ``documents``: five stages, each by one operator of provguard.llm.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and
read again as the next one's docs.  Stages 1 to 4 give the columns of documents.

1. quality: documents that the quality rules reject go.
2. near duplicates: of each group linked by the n-gram Jaccard join (5-word shingles,
   similarity 0.8 or more) the row of the smallest doc_id stays (null after all others; of
   equal ids the smallest hash).
3. repeats: words of 13-word strings that a smaller doc_id also holds go; a document with
   no word left goes.
4. decontamination: documents that overlap a benchmark item go.
5. mixing: words taken from each document for the target weights.

Stages 2 and 4 judge rows, whatever their doc_id: each writes its rows with a row key first, and
the operators see the key as the id.  Rows of a null or a repeated id go only where they
are near copies or overlap an item themselves.  In stage 3 rows of equal ids do not take words
from each other.  Empty tables pass through.

Stages 2 and 4 write their decisions (row keys) and then drop what their operators wrote on the way, so
that only the keyed rows stay until the driver ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provguard.llm import decontaminate, mixing, ngram_join, quality_rules, substring_dedup
from provguard.llm.common import read_table, write_scratch
from provguard.session import drop_scratch, scratch_made


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def row_keys(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Docs with a row key beside them, and the column's name, which no other column has.  Written, so the keys stay."""
    key = f"row_{uuid.uuid4().hex}"
    return write_scratch(docs.withColumn(key, F.monotonically_increasing_id()), name), key


def row_hash(docs: DataFrame) -> Column:
    """Hash of all columns that can be hashed (maps cannot)."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])


def decided(spark: SparkSession, keys: DataFrame, before: list[str]) -> DataFrame:
    """A stage's decisions, written; what was written since ``before`` to reach them goes."""
    spent = [p for p in scratch_made() if p not in before]
    out = write_scratch(keys, "decided")
    drop_scratch(spark, spent)
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = row_keys(docs, "near-rows")
    before = scratch_made()
    groups = ngram_join.ngram_join(rows.select(F.col(key).alias("doc_id"), "text"), n=5, num=80, den=100)
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), row_hash(docs).alias("hash"), F.col(key).alias("row"))
    ranks = rows.select(F.col(key).alias("ranked"), rank.alias("rank"))
    first = (groups.join(ranks, F.col("doc_id") == F.col("ranked")).groupBy("component_id")
             .agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias(f"{key}_first")))
    first = decided(spark, first, before).hint("shuffle_hash")  # keys only, so the texts need no sort
    return rows.join(first, F.col(key) == F.col(f"{key}_first"), "left_semi").drop(key)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    carried = {c: f"carried_{uuid.uuid4().hex}" for c in docs.columns if c not in ("doc_id", "text", "n_chars")}
    out = substring_dedup.remove_repeats(docs.withColumnsRenamed(carried), carry=tuple(carried.values()))
    out = out.where("n_removed = 0 or n_removed < n_words")
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select(*[(F.col(carried[c]) if c in carried else new[c]).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = row_keys(docs, "decontamination-rows")
    before = scratch_made()
    found = decontaminate.find_overlaps(rows.select(F.col(key).alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"))
    bad = found.select(F.col("doc_id").alias(f"{key}_bad")).distinct()
    bad = decided(spark, bad, before)
    return rows.join(bad, F.col(key) == F.col(f"{key}_bad"), "left_anti").drop(key)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("decontamination", decontamination),
    ("mixing", mix),
]

# Stages 1 to 4 are not SQL: tests hold the whole against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_scratch(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
