"""User-level pipelines (X02-X12), each a pure DataFrame -> DataFrame function.

They take already-loaded frames (the clean exclusion list, claim lines) so
the same code runs on CSV, Parquet or the stand-ins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provguard.fixed import (NON_PHYSICIAN_SPECIALTIES, OTHER_JOBS, PHYSICIAN_GENERALS,
                             SPECIALTY_REWRITE, STATE_ABB, TERRITORIES_2000,
                             TERRITORIES_2021)
from provguard.functions.exprs import not_in_keep_null, presence_flag, ratio
from provguard.operators import aggregates as A
from provguard.operators import reshape as R
from provguard.operators import windows as W
from provguard.operators.filters import drop_null, filter_date_range
from provguard.operators.profile import median_by
from provguard.operators.joins import enrich, label_by_membership
from provguard.operators.sparse import code_index, sparse_vectors

PROVIDER_KEYS = ("rndrng_npi", "rndrng_prvdr_type", "rndrng_prvdr_gndr",
                 "rndrng_prvdr_state_abrvtn", "rndrng_prvdr_zip5", "rndrng_prvdr_ruca")


# --- X05 statute table -------------------------------------------------------

def statute_counts(clean: DataFrame, lookup: DataFrame,
                   lookup_rows: int | None = None) -> DataFrame:
    """Exclusions per statute, enriched with the lookup, largest first.

    Counting happens before the join (the lookup meets one row per code);
    codes absent from the lookup are kept with null descriptions.
    ``lookup_rows`` gives the size of a fixed lookup table.
    """
    counts = (A.count_by(clean, ["excltype"], "n_count")
              .withColumnRenamed("excltype", "statute"))
    out = enrich(counts, lookup, "statute", known_rows=lookup_rows)
    out = R.select_range(out, "agency", "description", before=["statute"], after=["n_count"])
    return out.orderBy(F.col("n_count").desc(), F.col("statute").asc_nulls_last())


# --- X02 provider features (Spark route) ----------------------------------------

def clean_claims(claims: DataFrame, provider_type: str = "Internal Medicine") -> DataFrame:
    """Participating providers of one type; services per beneficiary."""
    df = (claims.where(F.col("rndrng_prvdr_mdcr_prtcptg_ind") == "Y")
                .where(F.col("rndrng_prvdr_type") == provider_type)
                .select(*PROVIDER_KEYS, "hcpcs_cd", "tot_srvcs", "tot_benes"))
    return (df.withColumn("srvcs_per_bene", ratio("tot_srvcs", "tot_benes"))
              .drop("tot_srvcs", "tot_benes"))


def provider_matrix(clean: DataFrame, codes: Sequence[str] | None = None) -> DataFrame:
    """One row per provider, mean services per beneficiary per code; no code is the column ``NA``.

    ``codes`` fixes the columns (name ``NA`` too if lines without a code count)."""
    return R.pivot_agg(clean, list(PROVIDER_KEYS), "hcpcs_cd",
                       F.avg("srvcs_per_bene"), values=codes, null_label="NA")


def _label_excluded(providers: DataFrame, excluded: DataFrame, label: str) -> DataFrame:
    npis = excluded.select("npi").where(F.col("npi") != F.lit("NA"))
    return label_by_membership(providers, npis, "rndrng_npi", "npi", label, "true", "false")


def provider_features(claims: DataFrame, excluded: DataFrame, codes: Sequence[str] | None = None,
                      provider_type: str = "Internal Medicine", label: str = "fraud") -> DataFrame:
    """Provider matrix labelled ``true`` when the NPI is on the exclusion list."""
    return _label_excluded(provider_matrix(clean_claims(claims, provider_type), codes), excluded, label)


def provider_features_long(claims: DataFrame, excluded: DataFrame, provider_type: str = "Internal Medicine",
                           label: str = "fraud") -> DataFrame:
    """The same features in long form, one row per provider and code, for any number of codes."""
    long = R.long_agg(clean_claims(claims, provider_type), list(PROVIDER_KEYS), "hcpcs_cd",
                      F.avg("srvcs_per_bene"), "hcpcs_cd", "srvcs_per_bene")
    return _label_excluded(long, excluded, label)


def provider_features_sparse(claims: DataFrame, excluded: DataFrame, provider_type: str = "Internal Medicine",
                             label: str = "fraud") -> DataFrame:
    """One row per provider with a map of code to mean, for any number of codes."""
    sparse = R.sparse_agg(clean_claims(claims, provider_type), list(PROVIDER_KEYS), "hcpcs_cd", F.avg("srvcs_per_bene"))
    return _label_excluded(sparse, excluded, label)


def provider_features_vector(claims: DataFrame, excluded: DataFrame, provider_type: str = "Internal Medicine",
                             label: str = "fraud") -> tuple[DataFrame, DataFrame]:
    """(provider keys, ``codes`` as one sparse vector, label) and the index of codes: what models are
    fitted on when there are too many codes for columns."""
    long = R.long_agg(clean_claims(claims, provider_type), list(PROVIDER_KEYS), "hcpcs_cd", F.avg("srvcs_per_bene"), "hcpcs_cd", "srvcs_per_bene")
    index = code_index(long, "hcpcs_cd")
    vectors = sparse_vectors(long, list(PROVIDER_KEYS), "hcpcs_cd", "srvcs_per_bene", index, index.count())
    return _label_excluded(vectors, excluded, label), index


# --- X03 labelled claim lines ---------------------------------------------------

def labelled_claims(claims: DataFrame, mandatory: DataFrame, label: str = "fraud") -> DataFrame:
    """Claim lines (5 columns) with a yes/no mandatory-exclusion label."""
    lines = claims.select("rndrng_npi", "rndrng_prvdr_type", "place_of_srvc",
                          "hcpcs_cd", "tot_srvcs")
    return label_by_membership(lines, mandatory, "rndrng_npi", "rndrng_npi", label, "yes", "no")


def composite_matrix(labelled: DataFrame, values: Sequence[str] | None = None) -> DataFrame:
    """Services per ``code_place`` column, one row per provider and label."""
    df = drop_null(labelled)
    return R.pivot_agg(df, ["rndrng_npi", "rndrng_prvdr_type", "fraud"],
                       R.composite_key("hcpcs_cd", "place_of_srvc"),
                       F.sum("tot_srvcs"), values=values)


# --- X04 physician subset ----------------------------------------------------

PHYSICIAN_COLUMNS = ("specialty", "dob", "city", "state", "zip", "excltype",
                     "excldate", "age_at_excl", "npi_or_upin")


def physician_subset(clean: DataFrame, with_ids: bool = True) -> DataFrame:
    """Individual physicians with a mandatory exclusion and an identifier flag."""
    df = (clean.where(F.col("type") == "Individual")
               .where(F.col("exclusion") == "mandatory")
               .where(F.col("general").isin(list(PHYSICIAN_GENERALS)))
               .where(not_in_keep_null("specialty", NON_PHYSICIAN_SPECIALTIES))
               .select("general", "specialty", "upin", "npi", "dob", "city", "state",
                       "zip", "excltype", "excldate", "age_at_excl")
               .withColumn("npi_or_upin", presence_flag("npi", "upin"))
               .drop("npi", "upin", "general"))
    if not with_ids:
        return df
    ided = W.row_ids(df, list(PHYSICIAN_COLUMNS), "identifier")
    return ided.select("identifier", *PHYSICIAN_COLUMNS)


# --- X06 / X07 / X08 identifier completion --------------------------------------

def identifier_rates_by_year(clean: DataFrame) -> DataFrame:
    """Per year: present NPI and UPIN counts, rows and percentages."""
    return A.presence_rates(clean, [F.trunc("excldate", "year").alias("year")], ["npi", "upin"])


def identifier_rates_long(clean: DataFrame) -> DataFrame:
    """``(year, identifier, percent)`` with identifier in ``npi``, ``upin``."""
    wide = identifier_rates_by_year(clean).select("year", "pct_npi", "pct_upin")
    return R.unpivot(wide, ["year"], R.column_range(wide, "pct_npi", "pct_upin"),
                     "identifier", "percent", names_prefix="pct_")


def identifier_rates_state(clean: DataFrame, after: str = "2000-01-01",
                           territories: Sequence[str] = TERRITORIES_2000) -> DataFrame:
    """Per year and state: rows, missing NPIs and the completion share."""
    df = filter_date_range(clean, "excldate", after=after)
    df = df.where(not_in_keep_null("state", territories))
    df = drop_null(df, ["state"])
    g = df.groupBy(F.trunc("excldate", "year").alias("year"), "state").agg(
        F.count(F.lit(1)).alias("obs"), A.missing_count("npi").alias("missing"))
    return g.withColumn("pct", (F.col("obs") - F.col("missing")) / F.col("obs"))


def state_share_vs_rate(clean: DataFrame, after: str = "2021-01-01",
                        territories: Sequence[str] = TERRITORIES_2021) -> DataFrame:
    """Per state: NPI completion and the state's share of all exclusions."""
    df = filter_date_range(clean, "excldate", after=after)
    df = df.where(not_in_keep_null("state", territories))
    g = df.groupBy("state").agg(F.count(F.col("npi")).alias("n_npi"),
                                F.count(F.lit(1)).alias("n_obs"))
    g = g.withColumn("pct_npi", F.col("n_npi") / F.col("n_obs"))
    return A.share_of_total(g, "n_obs", "pct_excl")


def missing_by_state_year(clean: DataFrame, states: Sequence[str] = STATE_ABB) -> DataFrame:
    """Missing NPIs per year (rows) and state (fixed, ordered columns), zeros filled."""
    df = clean.select(F.year("excldate").alias("year"), "state", "npi")
    wide = R.pivot_agg(df, ["year"], "state", F.count_if(F.col("npi").isNull()),
                       values=list(states), fill=0)
    return R.select_ordered(wide, ["year", *states])


# --- X09 federal against state lists --------------------------------------------

def federal_years(clean: DataFrame, states: Sequence[str], agency: str = "cms_oig") -> DataFrame:
    """Federal totals of several states by year, in one pass."""
    return (A.count_by_year(clean.where(F.col("state").isin(list(states))), "excldate", ["state"])
            .withColumn("agency", F.lit(agency)))


def agency_year_compare(clean: DataFrame, state_totals: dict[str, DataFrame]) -> DataFrame:
    """Stack each state's yearly totals with the federal totals for that state."""
    columns = ["state", "agency", "year", "n"]
    out = federal_years(clean, list(state_totals)).select(*columns)
    for st, tot in state_totals.items():
        out = out.unionByName(tot.withColumn("state", F.lit(st)).select(*columns))
    return out


# --- X10 code variety --------------------------------------------------------

def distinct_codes(claims: DataFrame, state: str = "CA", top: int = 25) -> DataFrame:
    """Distinct procedure codes per provider type in one state, top ``top``."""
    g = A.count_distinct_by(claims, ["rndrng_prvdr_type", "rndrng_prvdr_state_abrvtn"],
                            "hcpcs_cd", "hcpcs_billed", include_null=True)
    g = g.where(F.col("rndrng_prvdr_state_abrvtn").isin(state))
    return g.orderBy(F.col("hcpcs_billed").desc(), F.col("rndrng_prvdr_type")).limit(top)


# --- shares, tops, orders ---------------------------------------------------------

def general_shares(clean: DataFrame, min_share: float = 0.01) -> DataFrame:
    """Professions of individuals: count, share, kept above ``min_share``, ordered."""
    g = A.count_by(clean.where(F.col("type") == "Individual"), ["general"], "n")
    g = A.share_of_total(g, "n", "n_pct").where(F.col("n_pct") > min_share)
    g = W.ordinal(g, [F.col("n").desc(), F.col("general").asc_nulls_last()], "order")
    return W.level_order(g, "n_pct", "general_ord")


def md_specialties(clean: DataFrame, top: int = 20) -> DataFrame:
    """Specialties of individual M.D.s (rewritten labels), share, top ``top``."""
    df = (clean.where(F.col("type") == "Individual")
               .where(F.col("general") == "MEDICAL PRACTICE, MD")
               .where(~F.coalesce(F.col("specialty").isin(list(OTHER_JOBS)), F.lit(False))
                      & F.col("specialty").isNotNull())
               .withColumn("specialty", F.regexp_replace(
                   "specialty", SPECIALTY_REWRITE[0], SPECIALTY_REWRITE[1])))
    g = A.share_of_total(A.count_by(df, ["specialty"], "n"), "n", "n_pct")
    return g.orderBy(F.col("n").desc(), F.col("specialty")).limit(top)


def top_statutes(clean: DataFrame, k: int = 10) -> DataFrame:
    g = A.count_by(clean, ["excltype"], "n")
    return g.orderBy(F.col("n").desc(), F.col("excltype").asc_nulls_last()).limit(k)


def lumped_statutes_by_year(clean: DataFrame, n: int = 5) -> DataFrame:
    """Statutes lumped to the top ``n`` over all rows, then individuals per year."""
    lumped = W.lump_top_n(clean, "excltype", n)
    ind = lumped.where(F.col("type") == "Individual")
    return A.count_by_year(ind, "excldate", ["excltype"], "exclusions")


def specialty_statute_matrix(clean: DataFrame, statutes: Sequence[str]) -> DataFrame:
    """Physician specialty x statute counts, zeros filled; a null statute is the column ``NA``."""
    df = (clean.where(F.col("type") == "Individual")
               .where(F.col("general").isin(list(PHYSICIAN_GENERALS)))
               .where(not_in_keep_null("specialty", NON_PHYSICIAN_SPECIALTIES))
               .where(F.col("specialty").isNotNull()))
    return R.pivot_count(df, ["specialty"], "excltype", statutes, fill=0, null_label="NA")


def matrix_zscores(clean: DataFrame, row: str, col: str) -> DataFrame:
    """Count matrix in long form (zeros included), z-scored per column.

    Every value of ``col`` in the data is a column; null is the column ``NA``."""
    return W.zscore_by(R.count_grid(clean, row, col), [col], "value", "z")


def age_by_statute(clean: DataFrame) -> DataFrame:
    """Median age per statute with the statutes ordered by it."""
    med = median_by(clean, ["excltype"], "age_at_excl", "median_age")
    return W.level_order(med, "median_age", "excltype_ord")


def federal_monthly(clean: DataFrame, years: float | None = None) -> DataFrame:
    return A.monthly_average(clean, "excldate", years)


def yearly_means(clean: DataFrame) -> DataFrame:
    """Per year: mean age and identifier presence, columns named ``mean_*``."""
    return clean.groupBy(F.year("excldate").alias("year")).agg(
        F.avg("age_at_excl").alias("mean_age_at_excl"),
        F.avg(F.col("npi").isNotNull().cast("double")).alias("mean_has_npi"),
        F.avg(F.col("upin").isNotNull().cast("double")).alias("mean_has_upin"),
        F.count(F.lit(1)).alias("n_obs"))


def md_year_exclusion(clean: DataFrame) -> DataFrame:
    """Yearly counts by exclusion class and profession, physicians only."""
    df = (clean.where(F.col("type") == "Individual")
               .where(F.col("general").isin(list(PHYSICIAN_GENERALS))))
    return A.count_by_year(df, "excldate", ["exclusion", "general"], "value")


def year_class_counts(clean: DataFrame) -> DataFrame:
    """Yearly counts by type and exclusion class."""
    return A.count_by_year(clean, "excldate", ["type", "exclusion"], "exclusions")


def md_year_general(clean: DataFrame) -> DataFrame:
    """Yearly counts of the two physician professions."""
    df = clean.where(F.col("general").isin(list(PHYSICIAN_GENERALS)))
    return A.count_by_year(df, "excldate", ["general"], "n")


def state_statute_matrix(clean: DataFrame, statutes: Sequence[str]) -> DataFrame:
    """State x statute counts, zeros filled; a null code is the ``NA`` column."""
    return R.pivot_count(clean, ["state"], "excltype", statutes, fill=0, null_label="NA")
