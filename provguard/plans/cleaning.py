"""Cleaning the exclusion list (X01) and the state lists.

``clean_exclusions`` is one projection-and-filter chain over the raw list;
it is narrow (no shuffle) and every filter on a typed column pushes to a
Parquet scan when the raw list is stored as Parquet.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provguard.fixed import NULL_TOKENS, UNITEMISED_CODES
from provguard.functions.exprs import (contains_or_false, date_lit, first_match,
                                       not_in_keep_null, parse_date, years_between)
from provguard.sources.csv import apply_null_tokens, repair_headers


def tokens_to_null(raw: DataFrame, tokens=NULL_TOKENS) -> DataFrame:
    """Lower-case headers and turn the list's missing-value tokens into null."""
    return apply_null_tokens(repair_headers(raw, "lower"), tokens)


def classify(df: DataFrame) -> DataFrame:
    """Add ``type`` (Individual / Entity) and ``exclusion`` (mandatory /
    permissive / other) from the last name and the statute code."""
    etype = F.col("excltype")
    return df.withColumns({
        "type": F.when(F.col("lastname").isNull(), F.lit("Entity"))
                 .otherwise(F.lit("Individual")),
        "exclusion": first_match([(contains_or_false(etype, "a"), "mandatory"),
                                  (contains_or_false(etype, "b"), "permissive")],
                                 "other"),
    })


def clean_exclusions(raw: DataFrame, cutoff: str | _dt.date = "2023-01-01",
                     tokens=NULL_TOKENS) -> DataFrame:
    """The clean list: active, itemised exclusions before ``cutoff``.

    Dates are parsed (bad text becomes null), rows dated on or after the
    cutoff or undated are dropped, reinstated and waived rows are dropped,
    ``type``, ``exclusion`` and ``age_at_excl`` are added, and unitemised
    statute codes are dropped (a null code is kept).
    """
    df = tokens_to_null(raw, tokens)
    df = df.withColumns({
        "excldate": parse_date("excldate", "yyyyMMdd"),
        "dob": parse_date("dob", "yyyyMMdd"),
    })
    df = (df.where(F.col("excldate") < date_lit(cutoff))
            .where(F.col("reindate").isNull())
            .where(F.col("waiverdate").isNull()))
    df = classify(df)
    df = df.withColumn("age_at_excl", years_between("excldate", "dob"))
    return df.where(not_in_keep_null("excltype", UNITEMISED_CODES))


def mandatory_npis(raw: DataFrame, label: str = "fraud", value: str = "yes") -> DataFrame:
    """``(rndrng_npi, fraud)`` for mandatory exclusions with an NPI (X03 list)."""
    df = tokens_to_null(raw)
    df = (df.select("npi", "excldate", "excltype")
            .withColumn("excldate", parse_date("excldate"))
            .where(not_in_keep_null("excltype", UNITEMISED_CODES))
            .where(contains_or_false("excltype", "a"))
            .where(F.col("npi").isNotNull()))
    return df.select(F.col("npi").alias("rndrng_npi"), F.lit(value).alias(label))


def state_list_years(df: DataFrame, date_col: str, agency: str, fmt: str | None = "M/d/yyyy",
                     null_token: str | None = None, start: str | None = None) -> DataFrame:
    """Yearly totals of a state list: ``(year, n, agency)``.

    Text dates are parsed with ``fmt`` (``None`` for date-time columns);
    ``null_token`` becomes null first; ``start`` keeps years on or after it.
    """
    c = F.col(date_col)
    if null_token is not None:
        c = F.when(c == F.lit(null_token), F.lit(None)).otherwise(c)
    d = parse_date(c, fmt) if fmt else c.cast("date")
    out = (df.select(F.trunc(d, "year").alias("year"))
             .groupBy("year").agg(F.count(F.lit(1)).alias("n")))
    if start is not None:
        out = out.where(F.col("year") >= date_lit(start))
    return out.withColumn("agency", F.lit(agency))
