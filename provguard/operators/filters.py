"""Row filters with R's null rules made explicit."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provguard.functions.exprs import (contains_or_false, date_lit, not_in_drop_null,
                                       not_in_keep_null)


def filter_eq(df: DataFrame, **equals) -> DataFrame:
    """Keep rows equal to every given value; a null never matches."""
    for c, v in equals.items():
        df = df.where(F.col(c) == F.lit(v))
    return df


def filter_in(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    return df.where(F.col(column).isin(list(values)))


def filter_not_in(df: DataFrame, column: str, values: Iterable,
                  keep_null: bool = True) -> DataFrame:
    """Drop listed values; ``keep_null`` keeps rows whose value is null."""
    pred = not_in_keep_null if keep_null else not_in_drop_null
    return df.where(pred(column, values))


def filter_null(df: DataFrame, *columns: str) -> DataFrame:
    """Keep rows null in every named column."""
    for c in columns:
        df = df.where(F.col(c).isNull())
    return df


def drop_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows null in any of ``columns`` (all columns when None)."""
    return df.na.drop(how="any", subset=list(columns) if columns else None)


def filter_date_range(df: DataFrame, column: str, after: str | _dt.date | None = None,
                      before: str | _dt.date | None = None,
                      inclusive: bool = False) -> DataFrame:
    """Date bounds against literals; null dates are dropped.  The bound is a
    date literal, so the comparison pushes down to the Parquet scan."""
    c = F.col(column)
    if after is not None:
        df = df.where(c >= date_lit(after) if inclusive else c > date_lit(after))
    if before is not None:
        df = df.where(c <= date_lit(before) if inclusive else c < date_lit(before))
    return df


def filter_contains(df: DataFrame, column: str, needle: str) -> DataFrame:
    return df.where(contains_or_false(column, needle))


def filter_not_sentinel(df: DataFrame, column: str, sentinel: str = "NA") -> DataFrame:
    """Drop rows whose text equals a null sentinel (and real nulls)."""
    return df.where(F.col(column) != F.lit(sentinel))
