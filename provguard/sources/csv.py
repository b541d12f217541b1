"""Delimited-text sources: typed scan, null tokens, header repair, year stacks.

Schemas are always given, never inferred: inference costs a full pass over
the input and changes with the data.  ``infer=True`` exists for exploration.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# One-letter column type codes, as in ``col_types = "ccccii"``.
TYPE_CODES = {
    "c": T.StringType(),
    "i": T.LongType(),
    "d": T.DoubleType(),
    "n": T.DoubleType(),
    "l": T.BooleanType(),
    "D": T.DateType(),
    "T": T.TimestampNTZType(),
}


def schema_from_codes(codes: str, names: Sequence[str]) -> T.StructType:
    """Build a schema from a short type string; one code repeats to all."""
    if len(codes) == 1:
        codes = codes * len(names)
    if len(codes) != len(names):
        raise ValueError(f"{len(codes)} type codes for {len(names)} columns")
    return T.StructType([T.StructField(n, TYPE_CODES[c], True)
                         for n, c in zip(names, codes)])


def schema_from_map(columns: Mapping[str, str]) -> T.StructType:
    """Build a schema from a name-to-type map (``columns = list(...)``)."""
    return T.StructType([T.StructField(n, _simple_type(t), True)
                         for n, t in columns.items()])


def _simple_type(name: str) -> T.DataType:
    name = name.lower()
    return {
        "character": T.StringType(), "string": T.StringType(),
        "integer": T.LongType(), "int": T.LongType(), "bigint": T.LongType(),
        "numeric": T.DoubleType(), "double": T.DoubleType(),
        "logical": T.BooleanType(), "boolean": T.BooleanType(),
        "date": T.DateType(), "timestamp": T.TimestampNTZType(),
    }[name]


# --- header repair -----------------------------------------------------------

def snake_name(name: str) -> str:
    """A name in snake case by the rules of R's ``make_clean_names``.

    Quote marks vanish, ``%`` and ``#`` become words, accents fall away, camel case is
    split, everything else that is no letter or digit parts words."""
    s = re.sub(r"['\"\u2018\u2019]", "", name.strip())
    s = s.replace("%", "_percent_").replace("#", "_number_")
    s = unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", s)
    s = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", s)
    s = re.sub(r"[^0-9A-Za-z]+", "_", s).strip("_").lower()
    if not s:
        s = "x"
    if s[0].isdigit():
        s = "x" + s
    return s


def unique_names(names: Sequence[str]) -> list[str]:
    """Give repeats the suffixes ``_2``, ``_3`` ... until all names differ."""
    names = list(names)
    while len(set(names)) < len(names):
        counts = [names[:i + 1].count(n) for i, n in enumerate(names)]
        names = [n if k == 1 else f"{n}_{k}" for n, k in zip(names, counts)]
    return names


def repair_headers(df: DataFrame, style: str = "lower") -> DataFrame:
    """Rename every column: ``lower`` case, or ``snake`` case, all names distinct."""
    fn = str.lower if style == "lower" else snake_name
    return df.toDF(*unique_names([fn(c) for c in df.columns]))


# --- null tokens -------------------------------------------------------------

def apply_null_tokens(df: DataFrame, tokens: Iterable[str],
                      columns: Sequence[str] | None = None) -> DataFrame:
    """Turn any of several text tokens into null, in string columns only.

    Spark's CSV ``nullValue`` takes a single token, so this is one
    ``na.replace`` over the string columns (a single projection that fuses
    into the scan's codegen stage).  Surrounding blanks are removed at the
    scan (``trim_ws``), as the study's reader does.
    """
    strings = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    targets = [c for c in (columns or df.columns) if c in strings]
    if not targets:
        return df
    return df.na.replace(list(tokens), None, subset=targets)


# --- scans -------------------------------------------------------------------

def read_csv(spark: SparkSession, paths: str | Sequence[str],
             schema: T.StructType | None = None, header: bool = True,
             null_tokens: Iterable[str] | None = None, headers: str | None = None,
             columns: Sequence[str] | None = None, infer: bool = False,
             limit: int | None = None, persist: bool = False,
             trim_ws: bool = True) -> DataFrame:
    """Scan CSV with a fixed schema.

    ``headers`` repairs names (``lower`` / ``snake``); ``columns`` prunes at
    the scan (the CSV reader parses only the requested columns);
    ``null_tokens`` turns several tokens into null; ``trim_ws`` strips
    blanks around values; ``limit`` caps rows
    (``n_max``), unlimited by default; ``persist`` keeps the table in memory
    and disk (``memory = TRUE``).
    """
    reader = (spark.read.option("header", header).option("mode", "PERMISSIVE")
              .option("ignoreLeadingWhiteSpace", trim_ws)
              .option("ignoreTrailingWhiteSpace", trim_ws))
    if schema is not None:
        reader = reader.schema(schema)
    elif infer:
        reader = reader.option("inferSchema", True)
    df = reader.csv(paths if isinstance(paths, str) else list(paths))
    if headers:
        df = repair_headers(df, headers)
    if columns:
        df = df.select(*columns)
    if null_tokens is not None:
        df = apply_null_tokens(df, null_tokens)
    if limit is not None:
        df = df.limit(limit)
    if persist:
        from pyspark import StorageLevel
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    return df


def read_year_files(spark: SparkSession, paths: Sequence[str], schema: T.StructType,
                    year_pattern: str = r"(\d{4})", year_col: str = "year",
                    named: str = "file", **kwargs) -> DataFrame:
    """Read several yearly files as one table, with the year taken from the file name.

    One scan over all files (not one scan per year stacked by union).  The year is the
    last match of ``year_pattern`` in the file's name, or in its folder's name
    (``named="folder"``, for folders that Spark wrote); null without a match.
    """
    df = read_csv(spark, list(paths), schema=schema, **kwargs)
    name = F.col("_metadata.file_name") if named == "file" else \
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    found = F.regexp_extract_all(name, F.lit(year_pattern), F.lit(1))
    return df.withColumn(year_col, F.try_element_at(found, F.lit(-1)).try_cast("int"))


def read_gzip_csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType,
                  partitions: int | None = None, **kwargs) -> DataFrame:
    """Read gzip-compressed CSV.  Gzip is not splittable (one task per file), so fewer files
    than cores are spread by a round-robin repartition before heavy work."""
    df = read_csv(spark, paths, schema=schema, **kwargs)
    n = partitions or spark.sparkContext.defaultParallelism
    return df.repartition(n) if partitions or len(df.inputFiles()) < n else df


def stack_frames(frames: Mapping[int, DataFrame] | Sequence[DataFrame],
                 tag_col: str | None = "year") -> DataFrame:
    """Stack tables by column name, keeping duplicates (``bind_rows``).

    Missing columns are filled with nulls; with a mapping the key is added as
    a tag column.
    """
    if isinstance(frames, Mapping):
        items = [df.withColumn(tag_col, F.lit(k)) if tag_col else df
                 for k, df in frames.items()]
    else:
        items = list(frames)
    out = items[0]
    for df in items[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def schema_table(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The column names and types of a frame as rows ``(column, type)``."""
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return spark.createDataFrame(rows, "column string, type string")
