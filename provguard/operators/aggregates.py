"""Grouped counts, rates, sums, means and class tables.

All aggregates are algebraic (count, sum, avg) or rewritten by Spark into
two-level aggregations (count distinct), so a hot group is pre-aggregated on
the map side and never lands whole in one task.  Ratios of a group to the
grand total use a scalar subquery (one extra aggregate) rather than an
unpartitioned window, so the grouped rows never funnel into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provguard.functions.exprs import col, month_abbr, year_floor


def count_by(df: DataFrame, keys: Sequence[str | Column], name: str = "n") -> DataFrame:
    """Rows per group; a null key is its own group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def count_by_year(df: DataFrame, date_col: str, keys: Sequence[str] = (),
                  name: str = "n", year_col: str = "year") -> DataFrame:
    """Rows per calendar year (first day of year, a date) and categories."""
    return count_by(df, [year_floor(date_col).alias(year_col), *keys], name)


def presence_counts(df: DataFrame, keys: Sequence[str | Column],
                    columns: Sequence[str], total: str = "n_obs") -> DataFrame:
    """Per group: non-null count per column (``n_<col>``) and the row count."""
    aggs = [F.count(F.col(c)).alias(f"n_{c}") for c in columns]
    return df.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias(total))


def presence_rates(df: DataFrame, keys: Sequence[str | Column], columns: Sequence[str],
                   percent: bool = True, total: str = "n_obs") -> DataFrame:
    """``pct_<col>`` = non-null share of each column per group (x100 if percent)."""
    scale = 100.0 if percent else 1.0
    counts = presence_counts(df, keys, columns, total)
    return counts.withColumns({
        f"pct_{c}": F.col(f"n_{c}") / F.col(total) * F.lit(scale) for c in columns})


def missing_count(column: str) -> Column:
    return F.count_if(F.col(column).isNull())


def share_of_total(grouped: DataFrame, value: str = "n", name: str = "n_pct") -> DataFrame:
    """Each group's share of the grand total (``n / sum(n)``)."""
    total = grouped.agg(F.sum(F.col(value)).alias("_t")).scalar()
    return grouped.withColumn(name, F.col(value) / total)


def count_distinct_by(df: DataFrame, keys: Sequence[str], column: str,
                      name: str = "n_distinct", approx: bool = False,
                      rsd: float = 0.01, include_null: bool = False) -> DataFrame:
    """Distinct values per group; ``approx`` uses HyperLogLog++.

    SQL counts only non-null values; ``include_null`` counts a null as one
    more value, as R's ``n_distinct`` does by default.
    """
    agg = (F.approx_count_distinct(column, rsd) if approx
           else F.count_distinct(F.col(column)))
    if include_null:
        agg = agg + F.max(F.col(column).isNull().cast("long"))
    return df.groupBy(*keys).agg(agg.alias(name))


def mean_all(df: DataFrame, keys: Sequence[str] = (), columns: Sequence[str] | None = None,
             ) -> DataFrame:
    """Mean of every numeric column (nulls skipped), overall or per group."""
    numeric = columns or [f.name for f in df.schema.fields
                          if isinstance(f.dataType, T.NumericType) and f.name not in keys]
    aggs = [F.avg(F.col(c)).alias(c) for c in numeric]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def sum_by(df: DataFrame, keys: Sequence[str], column: str, name: str | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(F.col(column)).alias(name or column))


def monthly_average(df: DataFrame, date_col: str, years: float | None = None,
                    name: str = "count") -> DataFrame:
    """Events per calendar month divided by the number of years covered.

    ``years`` defaults to the distinct calendar years in the data (the study
    typed a fixed number).  Adds the month label and the mean over months.
    Everything derives from one (year, month) pre-aggregate of the input, so
    the scan and its shuffle are shared by the two scalar subqueries.
    """
    d = F.col(date_col)
    ym = (df.where(d.isNotNull())
            .groupBy(F.year(d).alias("_y"), F.month(d).alias("month"))
            .agg(F.count(F.lit(1)).alias("_n"), F.min(d).alias("_d")))
    if years is None:
        years_col = ym.agg(F.count_distinct("_y")).scalar()
    else:
        years_col = F.lit(float(years))
    per_month = ym.groupBy("month").agg(F.sum("_n").alias("_n"), F.min("_d").alias("_d"))
    per_month = per_month.select(
        "month", month_abbr("_d").alias("month_label"),
        (F.col("_n") / years_col).alias(name))
    avg = per_month.agg(F.avg(F.col(name))).scalar()
    return per_month.withColumn(f"avg_{name}", avg)


def freq_table(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Counts per value, nulls left out (R ``table``)."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(F.lit(1)).alias(name))


def class_balance(df: DataFrame, label: str, positive: object = "yes") -> DataFrame:
    """Positive rows, all rows and the positive percentage in one row."""
    return df.agg(
        F.count_if(F.col(label) == F.lit(positive)).alias("n_positive"),
        F.count(F.lit(1)).alias("n_rows"),
    ).withColumn("pct_positive", F.col("n_positive") / F.col("n_rows") * F.lit(100.0))


def histogram(df: DataFrame, column: str, binwidth: float, name: str = "n") -> DataFrame:
    """Fixed-width bins anchored at the column minimum: ``bin_start`` and count."""
    x = F.col(column).cast("double")
    lo = df.agg(F.min(x)).scalar()
    start = F.floor((x - lo) / F.lit(float(binwidth))) * F.lit(float(binwidth)) + lo
    return (df.where(x.isNotNull())
            .groupBy(start.alias("bin_start"))
            .agg(F.count(F.lit(1)).alias(name))
            .withColumn("bin_end", F.col("bin_start") + F.lit(float(binwidth))))


def row_count(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))
