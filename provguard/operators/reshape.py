"""Pivot and unpivot.

Wide pivots take an explicit value list whenever the caller has one, which saves Spark's
distinct-values job and fixes the output columns; otherwise all values of the data become
columns.  Codes too many for columns go into the sparse form (``sparse_agg``): one map of
code to value for each key, with no limit on the number of codes, built from the long form.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_values(df: DataFrame, column: str | Column) -> list:
    """Sorted distinct non-null values (the columns of a pivot: the driver plans them all)."""
    c = F.col(column) if isinstance(column, str) else column
    vals = df.select(c.alias("_v")).where(F.col("_v").isNotNull()).distinct().orderBy("_v").collect()
    return [r["_v"] for r in vals]


def long_agg(df: DataFrame, keys: Sequence[str], name: str | Column, agg: Column,
             names_to: str = "name", values_to: str = "value",
             null_label: str = "NA") -> DataFrame:
    """One row per key and value of ``name`` (null becomes ``null_label``), holding ``agg``."""
    c = F.col(name) if isinstance(name, str) else name
    return df.groupBy(*keys, F.coalesce(c.cast("string"), F.lit(null_label)).alias(names_to)).agg(agg.alias(values_to))


def sparse_agg(df: DataFrame, keys: Sequence[str], name: str | Column, agg: Column,
               column: str = "features", null_label: str = "NA") -> DataFrame:
    """One row per key with a map from each of its names to ``agg``; absent names are absent."""
    long = long_agg(df, keys, name, agg, "_name", "_value", null_label)
    return long.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_name", "_value")))).alias(column))


def pivot_agg(df: DataFrame, keys: Sequence[str], pivot: str | Column,
              agg: Column, values: Sequence | None = None, fill=None,
              null_label: str | None = None) -> DataFrame:
    """One row per key, one column per pivot value holding ``agg``.

    ``fill`` replaces absent cells (``replace_na(0)``); ``null_label`` names
    the column for a null pivot value (else such rows are dropped).
    """
    p = F.col(pivot) if isinstance(pivot, str) else pivot
    if null_label is not None:
        p = F.coalesce(p, F.lit(null_label))
    data = df.withColumn("_pivot", p)
    if values is None:
        values = distinct_values(data, "_pivot")
    values = list(values)
    out = data.groupBy(*keys).pivot("_pivot", values).agg(agg)
    if fill is not None:
        out = out.na.fill(fill, subset=[str(v) for v in values])
    return out


def pivot_count(df: DataFrame, keys: Sequence[str], pivot: str, values: Sequence | None = None,
                fill: int = 0, null_label: str | None = None) -> DataFrame:
    """Count matrix with zeros for absent cells."""
    return pivot_agg(df, keys, pivot, F.count(F.lit(1)), values, fill, null_label)


def count_grid(df: DataFrame, row: str, col: str, value: str = "value", null_label: str = "NA") -> DataFrame:
    """The count matrix in long form, zeros included: (row, col, value) for every row and every level of ``col``.

    Each row gathers a map of its counts; the levels are one array (a scalar subquery) exploded beside
    it.  No level reaches the driver, and the plan does not grow with their number."""
    level = F.coalesce(F.col(col).cast("string"), F.lit(null_label))
    counts = df.groupBy(row, level.alias("_level")).agg(F.count(F.lit(1)).alias("_n"))
    levels = counts.select("_level").distinct().agg(F.sort_array(F.collect_list("_level"))).scalar()
    by_row = counts.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("_level", "_n"))).alias("_held"))
    cells = by_row.select(row, "_held", F.explode(levels).alias(col))
    return cells.select(row, col, F.coalesce(F.try_element_at("_held", F.col(col)), F.lit(0).cast("long")).alias(value))


def composite_key(*cols: str, sep: str = "_") -> Column:
    """``names_from = c(a, b)``: the values joined by ``sep``."""
    return F.concat_ws(sep, *[F.col(c).cast("string") for c in cols])


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str],
            names_to: str = "name", values_to: str = "value",
            names_prefix: str | None = None) -> DataFrame:
    """Columns to rows; ``names_prefix`` is stripped from the name column."""
    out = df.unpivot(list(ids), list(columns), names_to, values_to)
    if names_prefix:
        out = out.withColumn(names_to, F.regexp_replace(
            F.col(names_to), "^" + re.escape(names_prefix), ""))
    return out


def matching_columns(df: DataFrame, pattern: str) -> list[str]:
    rx = re.compile(pattern)
    return [c for c in df.columns if rx.search(c)]


def unpivot_matching(df: DataFrame, pattern: str, names_to: str = "name",
                     values_to: str = "value") -> DataFrame:
    """Unpivot the columns whose name matches ``pattern``; others are ids."""
    cols = matching_columns(df, pattern)
    ids = [c for c in df.columns if c not in cols]
    return unpivot(df, ids, cols, names_to, values_to)


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last`` inclusive, in frame order (``a:b``)."""
    cols = df.columns
    i, j = cols.index(first), cols.index(last)
    return cols[i:j + 1] if i <= j else cols[j:i + 1][::-1]


def select_range(df: DataFrame, first: str, last: str,
                 before: Sequence[str] = (), after: Sequence[str] = ()) -> DataFrame:
    return df.select(*before, *column_range(df, first, last), *after)


def select_ordered(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Select names in the given order; a missing name is an error."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")
    return df.select(*names)


def insert_before(df: DataFrame, name: str, value: Column, before: str) -> DataFrame:
    """Add a column placed just before another (``.before =``)."""
    cols = [c for c in df.columns if c != name]
    i = cols.index(before)
    return df.withColumn(name, value).select(*cols[:i], name, *cols[i:])
