"""Registered queries and their SQL oracles.

Each key maps to ``fn(spark, base_dir) -> DataFrame`` over the driver
tables (through the stand-ins), and, where the result is expressible in
SQL, to an independent DuckDB query over the same tables.  Floats are
rounded to 6 places on both sides, integers are BIGINT unless Spark gives
INT (calendar years), and every computed column has the same alias on both
sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provguard.fixed import (NON_PHYSICIAN_SPECIALTIES, OTHER_JOBS, PHYSICIAN_GENERALS,
                             STATE_ABB, STATUTE_LOOKUP, TERRITORIES_2000, TERRITORIES_2021,
                             UNITEMISED_CODES)
from provguard.functions import exprs as X
from provguard.operators import aggregates as A
from provguard.operators import forest as FO
from provguard.operators import filters as FL
from provguard.operators import profile as P
from provguard.operators import reshape as R
from provguard.operators import windows as W
from provguard.operators import models as M
from provguard.operators import sketches as SK
from provguard.operators import sparse as SP
from provguard.operators.joins import label_by_bloom, label_by_membership, left_join_fanout
from provguard.plans import cleaning as C
from provguard.plans import pipelines as PL
from provguard.plans import standins as S
from provguard.plans.oracle import (CLAIMS_CTE, EXCL_BASE, EXCL_RAW_CTE, EXCL_TOK_CTE,
                                    MANDATORY_CTE, STATUTE_CTE, q, sql_in, with_ctes)
from provguard.sources import csv as CSV
from provguard.sources import sinks, store
from provguard.session import scratch_path
from provguard.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(X.col(c).cast("double"), 6)


# Itemised statute codes of the lookup (pivot columns), plus "NA" for null.
ITEMISED = tuple(r[0] for r in STATUTE_LOOKUP if r[0] not in UNITEMISED_CODES)
PIVOT_CODES = ITEMISED + ("NA",)

EXCL = with_ctes(*EXCL_BASE)
EXCL_CLAIMS = with_ctes(*EXCL_BASE, CLAIMS_CTE)


def _raw(spark, base):
    return S.exclusion_raw(spark, base)


def _clean(spark, base):
    return C.clean_exclusions(S.exclusion_raw(spark, base), S.EXCLUSION_CUTOFF)


def _claims(spark, base):
    return S.claims(spark, base)


# =============================================================================
# Pipelines
# =============================================================================

@register("clean_exclusions", EXCL + "SELECT * FROM excl")
def q_clean_exclusions(spark, base):
    return _clean(spark, base)


@register("statute_counts", with_ctes(*EXCL_BASE, STATUTE_CTE) + """
SELECT c.statute, l.agency, l.exclusion, l.description, c.n_count
FROM (SELECT excltype AS statute, count(*) AS n_count FROM excl GROUP BY excltype) c
LEFT JOIN statute_lookup l ON c.statute = l.statute
ORDER BY c.n_count DESC, c.statute NULLS LAST""")
def q_statute_counts(spark, base):
    return PL.statute_counts(_clean(spark, base), S.statute_lookup(spark), len(STATUTE_LOOKUP))


_PROVIDER_KEYS_SQL = ", ".join(PL.PROVIDER_KEYS)


_CC_CTE = f""", cc AS (
  SELECT {_PROVIDER_KEYS_SQL}, hcpcs_cd,
         CASE WHEN tot_benes = 0 THEN NULL ELSE tot_srvcs / tot_benes END AS srvcs_per_bene
  FROM claims
  WHERE rndrng_prvdr_mdcr_prtcptg_ind = 'Y' AND rndrng_prvdr_type = 'Internal Medicine'
)"""
_MEAN_COLS = ",\n       ".join(
    f"round(avg(srvcs_per_bene) FILTER (WHERE coalesce(hcpcs_cd, 'NA') = '{c}'), 6) AS \"{c}\"" for c in S.CLAIM_CODES)
_FRAUD_SQL = ("CASE WHEN EXISTS (SELECT 1 FROM excl e WHERE e.npi = m.rndrng_npi)"
              " THEN 'true' ELSE 'false' END AS fraud")
_FEATURES_SQL = with_ctes(*EXCL_BASE, CLAIMS_CTE) + _CC_CTE + f"""
, m AS (SELECT {_PROVIDER_KEYS_SQL},
       {_MEAN_COLS}
  FROM cc GROUP BY {_PROVIDER_KEYS_SQL})
"""


@register("provider_features", _FEATURES_SQL + f"SELECT m.*, {_FRAUD_SQL} FROM m")
def q_provider_features(spark, base):
    out = PL.provider_features(_claims(spark, base), _clean(spark, base), S.CLAIM_CODES)
    return out.withColumns({c: r6(f"`{c}`") for c in S.CLAIM_CODES})


@register("provider_features_long", with_ctes(*EXCL_BASE, CLAIMS_CTE) + _CC_CTE + f"""
, m AS (SELECT {_PROVIDER_KEYS_SQL}, coalesce(hcpcs_cd, 'NA') AS hcpcs_cd, round(avg(srvcs_per_bene), 6) AS srvcs_per_bene
  FROM cc GROUP BY ALL)
SELECT m.*, {_FRAUD_SQL} FROM m""")
def q_provider_features_long(spark, base):
    out = PL.provider_features_long(_claims(spark, base), _clean(spark, base))
    return out.withColumn("srvcs_per_bene", r6("srvcs_per_bene"))


@register("provider_features_sparse", with_ctes(*EXCL_BASE, CLAIMS_CTE) + _CC_CTE + f"""
, v AS (SELECT {_PROVIDER_KEYS_SQL}, coalesce(hcpcs_cd, 'NA') AS hcpcs_cd, avg(srvcs_per_bene) AS mean FROM cc GROUP BY ALL)
, m AS (SELECT {_PROVIDER_KEYS_SQL}, count(*) AS n_codes, round(sum(mean), 6) AS sum_means FROM v GROUP BY ALL)
SELECT m.*, {_FRAUD_SQL} FROM m""")
def q_provider_features_sparse(spark, base):
    """Size and sum of each provider's sparse features."""
    out = PL.provider_features_sparse(_claims(spark, base), _clean(spark, base))
    total = F.aggregate(F.map_values("features"), F.lit(None).cast("double"),
                        lambda a, x: F.coalesce(a + x, x, a))
    return out.select(*PL.PROVIDER_KEYS, F.size("features").cast("long").alias("n_codes"), r6(total).alias("sum_means"), "fraud")


@register("labelled_claims", with_ctes(*EXCL_BASE[:2], CLAIMS_CTE, MANDATORY_CTE) + """
SELECT c.rndrng_npi, c.rndrng_prvdr_type, c.place_of_srvc, c.hcpcs_cd, c.tot_srvcs,
       CASE WHEN EXISTS (SELECT 1 FROM mandatory m WHERE m.rndrng_npi = c.rndrng_npi)
            THEN 'yes' ELSE 'no' END AS fraud
FROM claims c""")
def q_labelled_claims(spark, base):
    return PL.labelled_claims(_claims(spark, base), C.mandatory_npis(_raw(spark, base)))


_PHYS_ORDER = ", ".join(f"{c} ASC NULLS FIRST" for c in PL.PHYSICIAN_COLUMNS)
_PHYS_SQL = f"""SELECT specialty, dob, city, state, zip, excltype, excldate, age_at_excl,
         CASE WHEN npi IS NULL AND upin IS NULL THEN 0 ELSE 1 END AS npi_or_upin
  FROM excl
  WHERE type = 'Individual' AND exclusion = 'mandatory'
    AND general IN {sql_in(PHYSICIAN_GENERALS)}
    AND NOT coalesce(specialty IN {sql_in(NON_PHYSICIAN_SPECIALTIES)}, false)"""


@register("physician_subset", EXCL + f"""
, ps AS ({_PHYS_SQL})
SELECT row_number() OVER (ORDER BY {_PHYS_ORDER}) AS identifier, * FROM ps""")
def q_physician_subset(spark, base):
    return PL.physician_subset(_clean(spark, base))


@register("unpivot_rates", EXCL + """
, r AS (
  SELECT CAST(date_trunc('year', excldate) AS DATE) AS year,
         count(npi) / count(*) * 100.0 AS pct_npi, count(upin) / count(*) * 100.0 AS pct_upin
  FROM excl GROUP BY 1
)
SELECT year, 'npi' AS identifier, round(pct_npi, 6) AS percent FROM r
UNION ALL
SELECT year, 'upin' AS identifier, round(pct_upin, 6) AS percent FROM r""")
def q_unpivot_rates(spark, base):
    return PL.identifier_rates_long(_clean(spark, base)).withColumn("percent", r6("percent"))


@register("identifier_rates_state", EXCL + f"""
SELECT CAST(date_trunc('year', excldate) AS DATE) AS year, state,
       count(*) AS obs, count(*) FILTER (WHERE npi IS NULL) AS missing,
       round((count(*) - count(*) FILTER (WHERE npi IS NULL)) / count(*), 6) AS pct
FROM excl
WHERE excldate > DATE '1997-01-01'
  AND NOT coalesce(state IN {sql_in(TERRITORIES_2000)}, false)
  AND state IS NOT NULL
GROUP BY 1, 2""")
def q_identifier_rates_state(spark, base):
    out = PL.identifier_rates_state(_clean(spark, base), after="1997-01-01")
    return out.withColumn("pct", r6("pct"))


@register("state_share_vs_rate", EXCL + f"""
, g AS (
  SELECT state, count(npi) AS n_npi, count(*) AS n_obs
  FROM excl
  WHERE excldate > DATE '2000-01-01'
    AND NOT coalesce(state IN {sql_in(TERRITORIES_2021)}, false)
  GROUP BY state
)
SELECT state, n_npi, n_obs, round(n_npi / n_obs, 6) AS pct_npi,
       round(n_obs / (SELECT sum(n_obs) FROM g), 6) AS pct_excl
FROM g""")
def q_state_share_vs_rate(spark, base):
    out = PL.state_share_vs_rate(_clean(spark, base), after="2000-01-01")
    return out.withColumns({"pct_npi": r6("pct_npi"), "pct_excl": r6("pct_excl")})


@register("agency_year_compare", EXCL + f"""
, ca AS (
  SELECT CAST(try_strptime(CASE WHEN l_orderkey % 50 = 0 THEN NULL
                                ELSE strftime(l_shipdate, '%-m/%-d/%Y') END, '%m/%d/%Y') AS DATE) AS d
  FROM lineitem
), ny AS (
  SELECT CAST(try_strptime(strftime(o_orderdate, '%-m/%-d/%Y'), '%m/%d/%Y') AS DATE) AS d
  FROM orders WHERE o_orderstatus <> 'F'
), tx AS (
  SELECT CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus = 'F'
)
SELECT * FROM (
  SELECT 'CA' AS state, 'ca_hhs' AS agency, CAST(date_trunc('year', d) AS DATE) AS year,
         count(*) AS n FROM ca GROUP BY 3
) WHERE year >= DATE '{S.STATE_LIST_START}'
UNION ALL
SELECT 'NY', 'ny_omig', CAST(date_trunc('year', d) AS DATE), count(*) FROM ny GROUP BY 3
UNION ALL
SELECT 'TX', 'tx_oig', CAST(date_trunc('year', d) AS DATE), count(*) FROM tx GROUP BY 3
UNION ALL
SELECT state, 'cms_oig', CAST(date_trunc('year', excldate) AS DATE), count(*)
FROM excl WHERE state IN ('CA', 'NY', 'TX') GROUP BY 1, 3""")
def q_agency_year_compare(spark, base):
    ca = CSV.repair_headers(S.state_list_ca(spark, base), "snake")
    ca = ca.withColumnsRenamed({"a_k_a_also_known_as_d_b_a_doing_business_as": "dba"})
    ny = S.state_list_ny(spark, base).withColumnsRenamed({"exclusion_effective_date": "excldate"})
    tx = S.state_list_tx(spark, base)
    totals = {
        "CA": C.state_list_years(ca, "date_of_suspension", "ca_hhs", "M/d/yyyy",
                                 null_token="N/A", start=S.STATE_LIST_START),
        "NY": C.state_list_years(ny, "excldate", "ny_omig", "M/d/yyyy"),
        "TX": C.state_list_years(tx, "StartDate", "tx_oig", None),
    }
    return PL.agency_year_compare(_clean(spark, base), totals)


@register("distinct_codes", with_ctes(CLAIMS_CTE) + """
SELECT rndrng_prvdr_type, rndrng_prvdr_state_abrvtn, count(DISTINCT hcpcs_cd) + CAST(bool_or(hcpcs_cd IS NULL) AS INTEGER) AS hcpcs_billed
FROM claims
GROUP BY 1, 2
HAVING rndrng_prvdr_state_abrvtn IN ('CA')
ORDER BY hcpcs_billed DESC, rndrng_prvdr_type
LIMIT 25""")
def q_distinct_codes(spark, base):
    return PL.distinct_codes(_claims(spark, base), "CA", 25)


@register("monthly_avg", EXCL + """
, m AS (
  SELECT month(excldate) AS month, strftime(min(excldate), '%b') AS month_label,
         count(*) / (SELECT count(DISTINCT year(excldate)) FROM excl) AS count
  FROM excl WHERE excldate IS NOT NULL GROUP BY 1
)
SELECT CAST(month AS INTEGER) AS month, month_label, round(count, 6) AS count,
       round((SELECT avg(count) FROM m), 6) AS avg_count
FROM m""")
def q_monthly_avg(spark, base):
    out = PL.federal_monthly(_clean(spark, base))
    return out.withColumns({"count": r6("count"), "avg_count": r6("avg_count")})


_PHYS_INDIV = f"""type = 'Individual' AND general IN {sql_in(PHYSICIAN_GENERALS)}"""


@register("year_class_counts", EXCL + """
SELECT CAST(date_trunc('year', excldate) AS DATE) AS year, type, exclusion, count(*) AS exclusions
FROM excl GROUP BY 1, 2, 3""")
def q_year_class_counts(spark, base):
    return PL.year_class_counts(_clean(spark, base))


@register("md_year_exclusion", EXCL + f"""
SELECT CAST(date_trunc('year', excldate) AS DATE) AS year, exclusion, general, count(*) AS value
FROM excl WHERE {_PHYS_INDIV} GROUP BY 1, 2, 3""")
def q_md_year_exclusion(spark, base):
    return PL.md_year_exclusion(_clean(spark, base))


@register("md_year_general", EXCL + f"""
SELECT CAST(date_trunc('year', excldate) AS DATE) AS year, general, count(*) AS n
FROM excl WHERE general IN {sql_in(PHYSICIAN_GENERALS)} GROUP BY 1, 2""")
def q_md_year_general(spark, base):
    return PL.md_year_general(_clean(spark, base))


def _code_cols_sql(codes, null_label=True):
    key = "coalesce(excltype, 'NA')" if null_label else "excltype"
    return ",\n       ".join(f"count(*) FILTER (WHERE {key} = '{c}') AS \"{c}\"" for c in codes)


@register("state_statute_matrix", EXCL + f"""
SELECT state,
       {_code_cols_sql(ITEMISED + ("NA",))}
FROM excl GROUP BY state""")
def q_state_statute_matrix(spark, base):
    return PL.state_statute_matrix(_clean(spark, base), ITEMISED + ("NA",))


@register("specialty_statute_matrix", EXCL + f"""
SELECT specialty,
       {_code_cols_sql(ITEMISED + ("NA",))}
FROM excl
WHERE {_PHYS_INDIV}
  AND NOT coalesce(specialty IN {sql_in(NON_PHYSICIAN_SPECIALTIES)}, false)
  AND specialty IS NOT NULL
GROUP BY specialty""")
def q_specialty_statute_matrix(spark, base):
    return PL.specialty_statute_matrix(_clean(spark, base), ITEMISED + ("NA",))


# =============================================================================
# Sources and sinks
# =============================================================================

@register("null_tokens", with_ctes(EXCL_RAW_CTE, EXCL_TOK_CTE) + "SELECT * FROM excl_tok")
def q_null_tokens(spark, base):
    return C.tokens_to_null(_raw(spark, base))


@register("scan_pruned", """
SELECT l_suppkey, l_partkey, l_returnflag, l_quantity FROM lineitem""")
def q_scan_pruned(spark, base):
    return read_table(spark, base, "lineitem",
                      ["l_suppkey", "l_partkey", "l_returnflag", "l_quantity"])


@register("preview_rows", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 25")
def q_preview_rows(spark, base):
    return read_table(spark, base, "orders").orderBy("o_orderkey").limit(25)


MESSY_LINEITEM = {
    "l_orderkey": "L_OrderKey", "l_partkey": "L PartKey", "l_suppkey": "l.suppkey",
    "l_linenumber": "Line Number", "l_quantity": "QUANTITY",
    "l_extendedprice": "ExtendedPrice", "l_discount": "discount%", "l_tax": "Tax",
    "l_returnflag": "Return Flag", "l_linestatus": "Line-Status", "l_shipdate": "Ship Date",
}


@register("clean_headers", """
SELECT l_orderkey AS l_order_key, l_partkey AS l_part_key, l_suppkey AS l_suppkey,
       l_linenumber AS line_number, l_quantity AS quantity,
       l_extendedprice AS extended_price, l_discount AS discount_percent, l_tax AS tax,
       l_returnflag AS return_flag, l_linestatus AS line_status, l_shipdate AS ship_date
FROM lineitem""")
def q_clean_headers(spark, base):
    li = read_table(spark, base, "lineitem")
    messy = li.toDF(*[MESSY_LINEITEM[c] for c in li.columns])
    return CSV.repair_headers(messy, "snake")


@register("stack_years", with_ctes(CLAIMS_CTE) + "SELECT *, year AS claim_year FROM claims WHERE year IS NOT NULL")
def q_stack_years(spark, base):
    """One pushed ship-date range for each year present, stacked by name."""
    first, last = read_table(spark, base, "lineitem", ["l_shipdate"]).agg(
        F.year(F.min("l_shipdate")), F.year(F.max("l_shipdate"))).first()
    if first is None:
        return _claims(spark, base).withColumn("claim_year", F.col("year"))
    return CSV.stack_frames({y: S.claims(spark, base, year=y) for y in range(first, last + 1)}, "claim_year")


# Types by name, as in a named map of columns; the rest of the study's 29 columns have no stand-in.
CLAIM_TYPES = {
    "rndrng_npi": "character", "rndrng_prvdr_type": "character", "rndrng_prvdr_gndr": "character",
    "rndrng_prvdr_state_abrvtn": "character", "rndrng_prvdr_zip5": "character", "rndrng_prvdr_ruca": "character",
    "rndrng_prvdr_mdcr_prtcptg_ind": "character", "hcpcs_cd": "character", "place_of_srvc": "character",
    "tot_srvcs": "numeric", "tot_benes": "integer", "year": "integer",
}


@register("scan_claims_map", with_ctes(CLAIMS_CTE) + "SELECT * REPLACE (CAST(year AS BIGINT) AS year) FROM claims")
def q_scan_claims_map(spark, base):
    """Claims as CSV, scanned with types from a named map and kept in memory."""
    path = sinks.write_csv(_claims(spark, base), scratch_path(spark, "claims-csv"))
    return CSV.read_csv(spark, path, schema=CSV.schema_from_map(CLAIM_TYPES), persist=True)


@register("scan_inferred", with_ctes(CLAIMS_CTE) + """
SELECT CAST(rndrng_npi AS INTEGER) AS rndrng_npi, rndrng_prvdr_type, hcpcs_cd, tot_srvcs,
       CAST(tot_benes AS INTEGER) AS tot_benes, year FROM claims""")
def q_scan_inferred(spark, base):
    """Claims as CSV, scanned with inferred types: keys and whole numbers turn into integers."""
    path = sinks.write_csv(_claims(spark, base).select(
        "rndrng_npi", "rndrng_prvdr_type", "hcpcs_cd", "tot_srvcs", "tot_benes", "year"), scratch_path(spark, "claims-csv"))
    return CSV.read_csv(spark, path, infer=True)


@register("scan_year_files", with_ctes(CLAIMS_CTE) + """
SELECT rndrng_npi, place_of_srvc, tot_srvcs, year AS file_year FROM claims WHERE year IS NOT NULL""")
def q_scan_year_files(spark, base):
    """A folder of claims for each year, read in one scan, the year from the folder's name."""
    claims = _claims(spark, base).where(F.col("year").isNotNull()).select("rndrng_npi", "place_of_srvc", "tot_srvcs", "year")
    path = scratch_path(spark, "claims-2013-by-year")
    claims.write.option("header", True).partitionBy("year").csv(path)
    return CSV.read_year_files(spark, [f"{path}/*"], CSV.schema_from_codes("ccd", ["rndrng_npi", "place_of_srvc", "tot_srvcs"]),
                               year_col="file_year", named="folder")


@register("sql_view", with_ctes(CLAIMS_CTE) + """
SELECT rndrng_prvdr_state_abrvtn AS state, place_of_srvc, count(*) AS n,
       round(sum(tot_srvcs), 6) AS tot_srvcs
FROM claims GROUP BY 1, 2""")
def q_sql_view(spark, base):
    _claims(spark, base).createOrReplaceTempView("pg_claims")
    return spark.sql("""
        SELECT rndrng_prvdr_state_abrvtn AS state, place_of_srvc, count(*) AS n,
               round(sum(tot_srvcs), 6) AS tot_srvcs
        FROM pg_claims GROUP BY 1, 2""")


@register("roundtrip_sink", EXCL + "SELECT * FROM excl")
def q_roundtrip_sink(spark, base):
    return sinks.roundtrip_parquet(spark, _clean(spark, base), "clean-exclusions")


@register("cached_view", """
SELECT *, 'size_' || CAST(p_size AS VARCHAR) AS p_size_label FROM part""")
def q_cached_view(spark, base):
    part = read_table(spark, base, "part")
    return sinks.materialise(part.withColumn("p_size_label", X.prefixed("p_size", "size_")),
                             "pg_part_labelled")


@register("scan_typed_csv", EXCL + "SELECT * FROM excl")
def q_scan_typed_csv(spark, base):
    raw = _raw(spark, base)
    path = sinks.scratch_path(spark, "exclusion-csv")
    sinks.write_csv(raw.toDF(*[c.upper() for c in raw.columns]), path)
    schema = CSV.schema_from_codes("c", [c.upper() for c in raw.columns])
    df = CSV.read_csv(spark, path, schema=schema, headers="lower")
    return C.clean_exclusions(df, S.EXCLUSION_CUTOFF)


@register("scan_gzip", with_ctes(CLAIMS_CTE) + "SELECT * FROM claims")
def q_scan_gzip(spark, base):
    cl = _claims(spark, base)
    path = sinks.scratch_path(spark, "claims-gz")
    sinks.write_csv(cl, path, compression="gzip")
    return CSV.read_gzip_csv(spark, path, cl.schema)


# =============================================================================
# Projections
# =============================================================================

@register("select_cols", with_ctes(CLAIMS_CTE) + """
SELECT rndrng_npi, rndrng_prvdr_type, rndrng_prvdr_gndr, rndrng_prvdr_state_abrvtn,
       hcpcs_cd, tot_srvcs, tot_benes
FROM claims""")
def q_select_cols(spark, base):
    cl = _claims(spark, base).select(
        "rndrng_npi", "rndrng_prvdr_type", "rndrng_prvdr_gndr", "rndrng_prvdr_state_abrvtn",
        "rndrng_prvdr_zip5", "hcpcs_cd", "place_of_srvc", "tot_srvcs", "tot_benes")
    return cl.drop("rndrng_prvdr_zip5", "place_of_srvc")


@register("select_range", EXCL + """
SELECT excltype, upin, npi, dob, address, city, state, zip FROM excl""")
def q_select_range(spark, base):
    return R.select_range(_clean(spark, base), "upin", "zip", before=["excltype"])


_STATE_COLS_SQL = ",\n       ".join(
    f"count(*) FILTER (WHERE state = '{s}' AND npi IS NULL) AS \"{s}\"" for s in STATE_ABB)


@register("pivot_fixed_cols", EXCL + f"""
SELECT CAST(year(excldate) AS INTEGER) AS year,
       {_STATE_COLS_SQL}
FROM excl GROUP BY 1""")
def q_pivot_fixed_cols(spark, base):
    return PL.missing_by_state_year(_clean(spark, base))


@register("unpivot_matching", EXCL + """
, y AS (
  SELECT CAST(year(excldate) AS INTEGER) AS year, avg(age_at_excl) AS mean_age_at_excl,
         avg(CASE WHEN npi IS NOT NULL THEN 1.0 ELSE 0.0 END) AS mean_has_npi,
         avg(CASE WHEN upin IS NOT NULL THEN 1.0 ELSE 0.0 END) AS mean_has_upin,
         count(*) AS n_obs
  FROM excl GROUP BY 1
)
SELECT year, n_obs, 'mean_age_at_excl' AS name, round(mean_age_at_excl, 6) AS value FROM y
UNION ALL SELECT year, n_obs, 'mean_has_npi', round(mean_has_npi, 6) FROM y
UNION ALL SELECT year, n_obs, 'mean_has_upin', round(mean_has_upin, 6) FROM y""")
def q_unpivot_matching(spark, base):
    long = R.unpivot_matching(PL.yearly_means(_clean(spark, base)), "^mean_")
    return long.withColumn("value", r6("value"))


@register("rename_cols", with_ctes(CLAIMS_CTE) + """
SELECT rndrng_npi AS npi, hcpcs_cd AS code, place_of_srvc AS place,
       CAST(tot_benes AS VARCHAR) AS tot_benes FROM claims""")
def q_rename_cols(spark, base):
    cl = _claims(spark, base).select("rndrng_npi", "hcpcs_cd", "place_of_srvc", "tot_benes")
    cl = cl.withColumnsRenamed({"rndrng_npi": "npi", "hcpcs_cd": "code",
                                "place_of_srvc": "place"})
    return cl.withColumn("tot_benes", F.col("tot_benes").cast("string"))


@register("derive_chain", with_ctes(CLAIMS_CTE) + """
SELECT rndrng_npi, hcpcs_cd,
       round(CASE WHEN tot_benes = 0 THEN NULL ELSE tot_srvcs / tot_benes END, 6) AS srvcs_per_bene,
       round(CASE WHEN tot_benes = 0 THEN NULL ELSE tot_srvcs / tot_benes END * 2, 6) AS srvcs_per_bene_x2
FROM claims""")
def q_derive_chain(spark, base):
    cl = _claims(spark, base).select("rndrng_npi", "hcpcs_cd", "tot_srvcs", "tot_benes")
    cl = (cl.withColumn("srvcs_per_bene", X.ratio("tot_srvcs", "tot_benes"))
            .withColumn("srvcs_per_bene_x2", F.col("srvcs_per_bene") * 2)
            .withColumn("srvcs_per_bene", r6("srvcs_per_bene"))
            .withColumn("srvcs_per_bene_x2", r6("srvcs_per_bene_x2")))
    return cl.drop("tot_srvcs", "tot_benes")


@register("row_ids", """
SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS row_id FROM orders""")
def q_row_ids(spark, base):
    o = read_table(spark, base, "orders", ["o_orderkey", "o_custkey"])
    return W.row_ids(o, ["o_orderkey"], "row_id")


_PIVOT_CODE_COLS = ",\n       ".join(
    f"count(*) FILTER (WHERE coalesce(excltype, 'NA') = '{c}') AS \"{c}\"" for c in PIVOT_CODES)


@register("pivot_count_zero", EXCL + f"""
SELECT general,
       {_PIVOT_CODE_COLS}
FROM excl GROUP BY general""")
def q_pivot_count_zero(spark, base):
    return R.pivot_count(_clean(spark, base), ["general"], "excltype", PIVOT_CODES,
                         fill=0, null_label="NA")


# =============================================================================
# Filters
# =============================================================================

@register("filter_eq", with_ctes(CLAIMS_CTE) + """
SELECT * FROM claims
WHERE rndrng_prvdr_mdcr_prtcptg_ind = 'Y' AND rndrng_prvdr_type = 'Internal Medicine'""")
def q_filter_eq(spark, base):
    return FL.filter_eq(_claims(spark, base), rndrng_prvdr_mdcr_prtcptg_ind="Y",
                        rndrng_prvdr_type="Internal Medicine")


@register("filter_in", EXCL + f"SELECT * FROM excl WHERE general IN {sql_in(PHYSICIAN_GENERALS)}")
def q_filter_in(spark, base):
    return FL.filter_in(_clean(spark, base), "general", PHYSICIAN_GENERALS)


@register("filter_not_in_keep_null", EXCL + f"""
SELECT * FROM excl WHERE NOT coalesce(specialty IN {sql_in(NON_PHYSICIAN_SPECIALTIES)}, false)""")
def q_filter_not_in_keep_null(spark, base):
    return FL.filter_not_in(_clean(spark, base), "specialty", NON_PHYSICIAN_SPECIALTIES)


@register("filter_not_in_drop_null", EXCL + f"""
SELECT * FROM excl WHERE specialty NOT IN {sql_in(OTHER_JOBS)}""")
def q_filter_not_in_drop_null(spark, base):
    return FL.filter_not_in(_clean(spark, base), "specialty", OTHER_JOBS, keep_null=False)


@register("filter_null", with_ctes(EXCL_RAW_CTE, EXCL_TOK_CTE) + """
SELECT * FROM excl_tok WHERE reindate IS NULL AND waiverdate IS NULL""")
def q_filter_null(spark, base):
    return FL.filter_null(C.tokens_to_null(_raw(spark, base)), "reindate", "waiverdate")


@register("drop_null_subset", EXCL + "SELECT * FROM excl WHERE npi IS NOT NULL")
def q_drop_null_subset(spark, base):
    return FL.drop_null(_clean(spark, base), ["npi"])


_NOT_NULL_ALL = " AND ".join(f"{c} IS NOT NULL" for c in PL.PHYSICIAN_COLUMNS)


@register("drop_null_any", EXCL + f"""
SELECT * FROM ({_PHYS_SQL}) WHERE {_NOT_NULL_ALL}""")
def q_drop_null_any(spark, base):
    return FL.drop_null(PL.physician_subset(_clean(spark, base), with_ids=False))


@register("filter_date_range", EXCL + """
SELECT * FROM excl WHERE excldate > DATE '1998-01-01' AND excldate < DATE '2000-07-01'""")
def q_filter_date_range(spark, base):
    return FL.filter_date_range(_clean(spark, base), "excldate", "1998-01-01", "2000-07-01")


@register("filter_contains", EXCL + """
SELECT * FROM excl WHERE coalesce(contains(excltype, 'a'), false)""")
def q_filter_contains(spark, base):
    return FL.filter_contains(_clean(spark, base), "excltype", "a")


@register("filter_sentinel", EXCL + """
SELECT npi, excltype FROM (SELECT coalesce(npi, 'NA') AS npi, excltype FROM excl)
WHERE npi <> 'NA'""")
def q_filter_sentinel(spark, base):
    # The clean list written as text carries "NA" for a missing NPI.
    text = _clean(spark, base).select(F.coalesce("npi", F.lit("NA")).alias("npi"), "excltype")
    return FL.filter_not_sentinel(text, "npi", "NA")


@register("share_having", EXCL + """
, g AS (SELECT general, count(*) AS n FROM excl WHERE type = 'Individual' GROUP BY general),
s AS (SELECT general, n, n / (SELECT sum(n) FROM g) AS n_pct FROM g),
h AS (SELECT * FROM s WHERE n_pct > 0.01)
SELECT general, n, round(n_pct, 6) AS n_pct,
       row_number() OVER (ORDER BY n DESC, general ASC NULLS LAST) AS "order",
       dense_rank() OVER (ORDER BY n_pct) AS general_ord
FROM h""")
def q_share_having(spark, base):
    return PL.general_shares(_clean(spark, base)).withColumn("n_pct", r6("n_pct"))


# =============================================================================
# Joins
# =============================================================================

@register("label_join", EXCL_CLAIMS + """
SELECT c.*, CASE WHEN EXISTS (SELECT 1 FROM excl e WHERE e.npi = c.rndrng_npi)
                 THEN 'yes' ELSE 'no' END AS fraud
FROM claims c""")
def q_label_join(spark, base):
    return label_by_membership(_claims(spark, base), _clean(spark, base).select("npi"),
                               "rndrng_npi", "npi", "fraud", "yes", "no")


@register("left_join_fanout", with_ctes(EXCL_RAW_CTE, EXCL_TOK_CTE, CLAIMS_CTE) + """
SELECT c.rndrng_npi, c.hcpcs_cd, c.place_of_srvc, c.tot_srvcs, e.excluded
FROM claims c
LEFT JOIN (SELECT npi, 1 AS excluded FROM excl_tok) e ON c.rndrng_npi = e.npi""")
def q_left_join_fanout(spark, base):
    listed = C.tokens_to_null(_raw(spark, base)).select(
        "npi", F.lit(1).alias("excluded"))
    cl = _claims(spark, base).select("rndrng_npi", "hcpcs_cd", "place_of_srvc", "tot_srvcs")
    return left_join_fanout(cl, listed, "rndrng_npi", "npi", ["excluded"])


# =============================================================================
# Aggregations
# =============================================================================

@register("group_count", EXCL + "SELECT state, count(*) AS n FROM excl GROUP BY state")
def q_group_count(spark, base):
    return A.count_by(_clean(spark, base), ["state"], "n")


@register("year_type_counts", EXCL + """
SELECT CAST(date_trunc('year', excldate) AS DATE) AS year, type, count(*) AS value
FROM excl GROUP BY 1, 2""")
def q_year_type_counts(spark, base):
    return A.count_by_year(_clean(spark, base), "excldate", ["type"], "value")


@register("identifier_rates", EXCL + """
SELECT CAST(date_trunc('year', excldate) AS DATE) AS year,
       count(npi) AS n_npi, count(upin) AS n_upin, count(*) AS n_obs,
       round(count(npi) / count(*) * 100.0, 6) AS pct_npi,
       round(count(upin) / count(*) * 100.0, 6) AS pct_upin
FROM excl GROUP BY 1""")
def q_identifier_rates(spark, base):
    out = PL.identifier_rates_by_year(_clean(spark, base))
    return out.withColumns({"pct_npi": r6("pct_npi"), "pct_upin": r6("pct_upin")})


@register("pivot_mean", with_ctes(CLAIMS_CTE) + _CC_CTE + f"""
SELECT {_PROVIDER_KEYS_SQL},
       {_MEAN_COLS}
FROM cc GROUP BY {_PROVIDER_KEYS_SQL}""")
def q_pivot_mean(spark, base):
    out = PL.provider_matrix(PL.clean_claims(_claims(spark, base)), S.CLAIM_CODES)
    return out.withColumns({c: r6(f"`{c}`") for c in S.CLAIM_CODES})


_LI_NUM = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
           "l_extendedprice", "l_discount", "l_tax")


@register("mean_all", "SELECT CASE WHEN l_discount = 0 THEN 'none' ELSE 'discounted' END AS discount_kind,\n"
          + ",\n".join(f"       round(avg({c}), 6) AS {c}" for c in _LI_NUM)
          + "\nFROM lineitem GROUP BY 1")
def q_mean_all(spark, base):
    li = read_table(spark, base, "lineitem", list(_LI_NUM)).withColumn(
        "discount_kind", F.when(F.col("l_discount") == 0, "none").otherwise("discounted"))
    out = A.mean_all(li, ["discount_kind"])
    return out.withColumns({c: r6(c) for c in _LI_NUM})


@register("group_sum", """
SELECT l_linenumber, round(sum(l_quantity), 6) AS l_quantity FROM lineitem GROUP BY 1""")
def q_group_sum(spark, base):
    li = read_table(spark, base, "lineitem", ["l_linenumber", "l_quantity"])
    return A.sum_by(li, ["l_linenumber"], "l_quantity").withColumn("l_quantity", r6("l_quantity"))


@register("percentiles", """
SELECT unnest([0.25, 0.5, 0.75]::DOUBLE[]) AS p,
       unnest(quantile_cont(l_quantity, [0.25, 0.5, 0.75]::DOUBLE[])) AS value
FROM lineitem""")
def q_percentiles(spark, base):
    li = read_table(spark, base, "lineitem", ["l_quantity"])
    return P.percentiles(li, "l_quantity", [0.25, 0.5, 0.75])


@register("median_by_group", EXCL + """
, m AS (SELECT excltype, CAST(median(age_at_excl) AS DOUBLE) AS median_age FROM excl GROUP BY 1)
SELECT excltype, median_age,
       dense_rank() OVER (ORDER BY median_age ASC NULLS FIRST) AS excltype_ord
FROM m""")
def q_median_by_group(spark, base):
    return PL.age_by_statute(_clean(spark, base))


@register("boxplot_stats", EXCL + """
, s AS (
  SELECT excltype, count(age_at_excl) AS n,
         quantile_cont(age_at_excl, 0.25) AS q1, quantile_cont(age_at_excl, 0.5) AS median,
         quantile_cont(age_at_excl, 0.75) AS q3
  FROM excl WHERE age_at_excl IS NOT NULL GROUP BY 1
), f AS (
  SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence
  FROM s
), e AS (
  SELECT x.excltype,
         min(CASE WHEN x.age_at_excl BETWEEN f.lower_fence AND f.upper_fence THEN x.age_at_excl END) AS whisker_low,
         max(CASE WHEN x.age_at_excl BETWEEN f.lower_fence AND f.upper_fence THEN x.age_at_excl END) AS whisker_high,
         count(*) FILTER (WHERE NOT (x.age_at_excl BETWEEN f.lower_fence AND f.upper_fence)) AS n_outliers
  FROM excl x JOIN f ON x.excltype = f.excltype
  WHERE x.age_at_excl IS NOT NULL
  GROUP BY 1
)
SELECT f.excltype, f.n, round(f.q1, 6) AS q1, round(f.median, 6) AS median, round(f.q3, 6) AS q3,
       round(f.iqr, 6) AS iqr, round(f.lower_fence, 6) AS lower_fence,
       round(f.upper_fence, 6) AS upper_fence,
       CAST(e.whisker_low AS DOUBLE) AS whisker_low, CAST(e.whisker_high AS DOUBLE) AS whisker_high,
       e.n_outliers
FROM f JOIN e ON f.excltype = e.excltype""")
def q_boxplot_stats(spark, base):
    out = P.boxplot_stats(_clean(spark, base), ["excltype"], "age_at_excl")
    return out.withColumns({c: r6(c) for c in ("q1", "median", "q3", "iqr",
                                               "lower_fence", "upper_fence")})


@register("freq_table", with_ctes(*EXCL_BASE[:2], CLAIMS_CTE, MANDATORY_CTE) + """
SELECT fraud, count(*) AS n FROM (
  SELECT CASE WHEN EXISTS (SELECT 1 FROM mandatory m WHERE m.rndrng_npi = c.rndrng_npi)
              THEN 'yes' ELSE 'no' END AS fraud
  FROM claims c) GROUP BY fraud""")
def q_freq_table(spark, base):
    return A.freq_table(q_labelled_claims(spark, base), "fraud")


@register("class_balance", with_ctes(*EXCL_BASE[:2], CLAIMS_CTE, MANDATORY_CTE) + """
, l AS (
  SELECT CASE WHEN EXISTS (SELECT 1 FROM mandatory m WHERE m.rndrng_npi = c.rndrng_npi)
              THEN 'yes' ELSE 'no' END AS fraud
  FROM claims c)
SELECT count(*) FILTER (WHERE fraud = 'yes') AS n_positive, count(*) AS n_rows,
       round(count(*) FILTER (WHERE fraud = 'yes') / count(*) * 100.0, 6) AS pct_positive
FROM l""")
def q_class_balance(spark, base):
    out = A.class_balance(q_labelled_claims(spark, base), "fraud", "yes")
    return out.withColumn("pct_positive", r6("pct_positive"))


@register("histogram", """
, b AS (SELECT floor((l_quantity - (SELECT min(l_quantity) FROM lineitem)) / 3.0) * 3.0
               + (SELECT min(l_quantity) FROM lineitem) AS bin_start FROM lineitem)
SELECT round(bin_start, 6) AS bin_start, count(*) AS n, round(bin_start + 3.0, 6) AS bin_end
FROM b GROUP BY bin_start""".replace(", b AS", "WITH b AS", 1))
def q_histogram(spark, base):
    li = read_table(spark, base, "lineitem", ["l_quantity"])
    out = A.histogram(li, "l_quantity", 3)
    return out.withColumns({"bin_start": r6("bin_start"), "bin_end": r6("bin_end")})


def _profile_sql() -> str:
    kinds = [("lastname", "c"), ("firstname", "c"), ("midname", "c"), ("busname", "c"),
             ("general", "c"), ("specialty", "c"), ("upin", "c"), ("npi", "c"),
             ("dob", "D"), ("address", "c"), ("city", "c"), ("state", "c"), ("zip", "c"),
             ("excltype", "c"), ("excldate", "D"), ("reindate", "c"), ("waiverdate", "c"),
             ("wvrstate", "c"), ("type", "f"), ("exclusion", "c"), ("age_at_excl", "n")]
    parts = []
    for name, k in kinds:
        kind = {"c": "character", "D": "Date", "n": "numeric", "f": "factor"}[k]
        mean = f"round(avg({name}), 6)" if k == "n" else "CAST(NULL AS DOUBLE)"
        dn = f"count(DISTINCT {name})" if k == "D" else "CAST(NULL AS BIGINT)"
        cn = f"count(DISTINCT {name})" if k == "c" else "CAST(NULL AS BIGINT)"
        parts.append(
            f"SELECT '{name}' AS skim_variable, '{kind}' AS skim_type, "
            f"count(*) FILTER (WHERE {name} IS NULL) AS n_missing, "
            f"round(1.0 - count(*) FILTER (WHERE {name} IS NULL) / count(*), 6) AS complete_rate, "
            f"{mean} AS numeric_mean, {dn} AS date_n_unique, {cn} AS character_n_unique FROM excl")
    return EXCL + "\nUNION ALL\n".join(parts)


@register("profile_columns", _profile_sql())
def q_profile_columns(spark, base):
    return P.profile_columns(_clean(spark, base), digits=6, factors=["type"])


@register("completion_table", EXCL + "SELECT * REPLACE (round(complete_rate, 3) AS complete_rate, round(numeric_mean, 3) AS numeric_mean)\nFROM ("
          + _profile_sql()[len(EXCL):] + ")\nORDER BY complete_rate DESC, skim_variable")
def q_completion_table(spark, base):
    """Completion rates of the list's columns, most complete first."""
    return P.completion_table(P.profile_columns(_clean(spark, base), factors=["type"]))


@register("describe_cols", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, count({c}) AS count, round(avg({c}), 6) AS mean, "
    f"round(stddev_samp({c}), 6) AS stddev, CAST(min({c}) AS DOUBLE) AS min, "
    f"CAST(max({c}) AS DOUBLE) AS max FROM lineitem" for c in _LI_NUM))
def q_describe_cols(spark, base):
    li = read_table(spark, base, "lineitem", list(_LI_NUM))
    out = P.describe_numeric(li, list(_LI_NUM))
    return out.withColumns({"mean": r6("mean"), "stddev": r6("stddev")})


@register("row_count", EXCL + "SELECT count(*) AS n FROM excl")
def q_row_count(spark, base):
    return A.row_count(_clean(spark, base))


# =============================================================================
# Windows, ordering, top-k
# =============================================================================

@register("share_of_total", EXCL + """
, g AS (SELECT state, count(*) AS n FROM excl GROUP BY state)
SELECT state, n, round(n / (SELECT sum(n) FROM g), 6) AS n_pct FROM g""")
def q_share_of_total(spark, base):
    g = A.count_by(_clean(spark, base), ["state"], "n")
    return A.share_of_total(g, "n", "n_pct").withColumn("n_pct", r6("n_pct"))


@register("lump_top_n", EXCL + """
, c AS (SELECT excltype, count(*) AS n FROM excl WHERE excltype IS NOT NULL GROUP BY 1),
r AS (SELECT excltype, rank() OVER (ORDER BY n DESC) AS rk FROM c),
lumped AS (SELECT count(*) AS k FROM r WHERE rk > 5),
keep AS (SELECT excltype FROM r WHERE rk <= 5 OR (SELECT k FROM lumped) <= 1),
x AS (
  SELECT e.excldate, e.type,
         CASE WHEN e.excltype IS NULL THEN NULL
              WHEN e.excltype IN (SELECT excltype FROM keep) THEN e.excltype
              ELSE 'Other' END AS excltype
  FROM excl e)
SELECT CAST(date_trunc('year', excldate) AS DATE) AS year, excltype, count(*) AS exclusions
FROM x WHERE type = 'Individual' GROUP BY 1, 2""")
def q_lump_top_n(spark, base):
    return PL.lumped_statutes_by_year(_clean(spark, base), 5)


@register("level_order", EXCL + """
, g AS (SELECT general, count(*) AS n FROM excl GROUP BY general)
SELECT general, n, dense_rank() OVER (ORDER BY n DESC) AS n_ord FROM g""")
def q_level_order(spark, base):
    g = A.count_by(_clean(spark, base), ["general"], "n")
    return W.level_order(g, "n", "n_ord", descending=True)




@register("matrix_zscore", EXCL + """
, cells AS (
  SELECT g.general, c.code AS excltype,
         (SELECT count(*) FROM excl e WHERE e.general IS NOT DISTINCT FROM g.general
                                      AND coalesce(e.excltype, 'NA') = c.code) AS value
  FROM (SELECT DISTINCT general FROM excl) g,
       (SELECT DISTINCT coalesce(excltype, 'NA') AS code FROM excl) c
)
SELECT general, excltype, CAST(value AS BIGINT) AS value,
       round((value - avg(value) OVER (PARTITION BY excltype))
             / nullif(stddev_samp(value) OVER (PARTITION BY excltype), 0), 6) AS z
FROM cells""")
def q_matrix_zscore(spark, base):
    out = PL.matrix_zscores(_clean(spark, base), "general", "excltype")
    return out.withColumn("z", r6("z"))


@register("top_k_groups", EXCL + """
SELECT excltype, count(*) AS n FROM excl GROUP BY excltype
ORDER BY n DESC, excltype NULLS LAST LIMIT 10""")
def q_top_k_groups(spark, base):
    return PL.top_statutes(_clean(spark, base), 10)


# =============================================================================
# Reshape
# =============================================================================

_CODE_PLACES = [f"{c}_{p}" for c in S.CLAIM_CODES[:-1] for p in S.CLAIM_PLACES]
_SUM_COLS = ",\n       ".join(
    f"round(sum(tot_srvcs) FILTER (WHERE hcpcs_cd || '_' || place_of_srvc = '{c}'), 6) AS \"{c}\"" for c in _CODE_PLACES)


@register("pivot_composite", with_ctes(*EXCL_BASE[:2], CLAIMS_CTE, MANDATORY_CTE) + f"""
, l AS (
  SELECT c.rndrng_npi, c.rndrng_prvdr_type, c.place_of_srvc, c.hcpcs_cd, c.tot_srvcs,
         CASE WHEN EXISTS (SELECT 1 FROM mandatory m WHERE m.rndrng_npi = c.rndrng_npi)
              THEN 'yes' ELSE 'no' END AS fraud
  FROM claims c
)
SELECT rndrng_npi, rndrng_prvdr_type, fraud,
       {_SUM_COLS}
FROM l WHERE rndrng_npi IS NOT NULL AND rndrng_prvdr_type IS NOT NULL
         AND place_of_srvc IS NOT NULL AND hcpcs_cd IS NOT NULL AND tot_srvcs IS NOT NULL
GROUP BY rndrng_npi, rndrng_prvdr_type, fraud""")
def q_pivot_composite(spark, base):
    lab = PL.labelled_claims(_claims(spark, base), C.mandatory_npis(_raw(spark, base)))
    out = PL.composite_matrix(lab, _CODE_PLACES)
    return out.withColumns({c: r6(f"`{c}`") for c in _CODE_PLACES})


# =============================================================================
# Scalar functions
# =============================================================================

@register("classify_exclusion", with_ctes(EXCL_RAW_CTE, EXCL_TOK_CTE) + """
SELECT excltype, lastname,
       CASE WHEN lastname IS NULL THEN 'Entity' ELSE 'Individual' END AS type,
       CASE WHEN coalesce(contains(excltype, 'a'), false) THEN 'mandatory'
            WHEN coalesce(contains(excltype, 'b'), false) THEN 'permissive'
            ELSE 'other' END AS exclusion
FROM excl_tok""")
def q_classify_exclusion(spark, base):
    df = C.tokens_to_null(_raw(spark, base)).select("excltype", "lastname")
    return C.classify(df)


@register("normalise_labels", EXCL + f"""
, g AS (
  SELECT regexp_replace(specialty, 'GENERAL PRACTICE/FP', 'GENERAL PRACTICE', 'g') AS specialty,
         count(*) AS n
  FROM excl
  WHERE type = 'Individual' AND general = 'MEDICAL PRACTICE, MD'
    AND specialty IS NOT NULL AND specialty NOT IN {sql_in(OTHER_JOBS)}
  GROUP BY 1
)
SELECT specialty, n, round(n / (SELECT sum(n) FROM g), 6) AS n_pct
FROM g ORDER BY n DESC, specialty LIMIT 20""")
def q_normalise_labels(spark, base):
    return PL.md_specialties(_clean(spark, base), 20).withColumn("n_pct", r6("n_pct"))


@register("parse_dates", with_ctes(EXCL_RAW_CTE, EXCL_TOK_CTE) + """
SELECT excldate AS excldate_text, CAST(try_strptime(excldate, '%Y%m%d') AS DATE) AS excldate,
       dob AS dob_text, CAST(try_strptime(dob, '%Y%m%d') AS DATE) AS dob
FROM excl_tok""")
def q_parse_dates(spark, base):
    df = C.tokens_to_null(_raw(spark, base))
    return df.select(F.col("excldate").alias("excldate_text"),
                     X.parse_date("excldate").alias("excldate"),
                     F.col("dob").alias("dob_text"), X.parse_date("dob").alias("dob"))


@register("age_at_event", EXCL + """
SELECT excldate, dob, CAST(year(excldate) AS INTEGER) AS excl_year,
       CAST(year(dob) AS INTEGER) AS birth_year, age_at_excl
FROM excl""")
def q_age_at_event(spark, base):
    return _clean(spark, base).select(
        "excldate", "dob", F.year("excldate").alias("excl_year"),
        F.year("dob").alias("birth_year"), "age_at_excl")


@register("identifier_flag", EXCL + """
SELECT npi, upin, CASE WHEN npi IS NULL AND upin IS NULL THEN 0 ELSE 1 END AS npi_or_upin
FROM excl""")
def q_identifier_flag(spark, base):
    return _clean(spark, base).select("npi", "upin",
                                      X.presence_flag("npi", "upin").alias("npi_or_upin"))


# =============================================================================
# Statistics and models
# =============================================================================

_CORR_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


@register("corr_matrix", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r FROM lineitem"
    for i, a in enumerate(_CORR_COLS) for j, b in enumerate(_CORR_COLS) if i > j))
def q_corr_matrix(spark, base):
    li = read_table(spark, base, "lineitem", list(_CORR_COLS))
    return P.corr_long(li, _CORR_COLS).withColumn("r", r6("r"))


@register("hash_split", """
SELECT o_orderkey,
       CASE WHEN substr(md5('1099:' || CAST(o_orderkey AS VARCHAR)), 1, 15) < '800000000000000'
            THEN 'training' ELSE 'test' END AS split
FROM orders""")
def q_hash_split(spark, base):
    o = read_table(spark, base, "orders", ["o_orderkey"])
    return o.withColumn("split", M.hash_split_label("o_orderkey", 0.5, seed=1099))


@register("simple_ols", """
SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
       round(regr_r2(l_extendedprice, l_quantity), 6) AS r2
FROM lineitem""")
def q_simple_ols(spark, base):
    li = read_table(spark, base, "lineitem", ["l_extendedprice", "l_quantity"])
    return M.ols_one(li, "l_extendedprice", "l_quantity")


def _ols_ctes(source: str, y: str, x1: str, x2: str) -> str:
    """Closed form of least squares of y on x1 and x2 over ``source``; ``e`` has the estimates."""
    return f"""
s AS (
  SELECT count(*) AS n, avg({x1}) AS m1, avg({x2}) AS m2, avg({y}) AS my,
         var_pop({x1}) * count(*) AS s11, var_pop({x2}) * count(*) AS s22,
         covar_pop({x1}, {x2}) * count(*) AS s12,
         covar_pop({x1}, {y}) * count(*) AS s1y,
         covar_pop({x2}, {y}) * count(*) AS s2y,
         var_pop({y}) * count(*) AS syy
  FROM {source}
), b AS (
  SELECT *, s11 * s22 - s12 * s12 AS d,
         (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
         (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2
  FROM s
), e AS (
  SELECT *, my - b1 * m1 - b2 * m2 AS b0, (syy - b1 * s1y - b2 * s2y) / (n - 3) AS sigma2 FROM b
)"""


_TERMS_SQL = """, t AS (
  SELECT 'l_quantity' AS term, b1 AS estimate, sqrt(sigma2 * s22 / d) AS std_err FROM e
  UNION ALL SELECT 'l_discount', b2, sqrt(sigma2 * s11 / d) FROM e
  UNION ALL SELECT '(Intercept)', b0,
         sqrt(sigma2 * (1.0 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / d)) FROM e
)
SELECT term, round(estimate, 3) AS estimate, round(std_err, 3) AS std_err,
       round(estimate / std_err, 3) AS t_value"""
_OLS_SQL = "WITH" + _ols_ctes("lineitem", "l_extendedprice", "l_quantity", "l_discount") + _TERMS_SQL


@register("ols_terms", _OLS_SQL + "\nFROM t")
def q_ols_terms(spark, base):
    """Least-squares term table (M06/M07) on the whole table, closed form in SQL."""
    li = read_table(spark, base, "lineitem", ["l_extendedprice", "l_quantity", "l_discount"])
    terms = M.linear_summary(li, "l_extendedprice ~ l_quantity + l_discount")
    return terms.select("term", *[F.round(c, 3).alias(c)
                                  for c in ("estimate", "std_err", "t_value")])


_SPLIT_SQL = "substr(md5('1099:' || CAST(o_orderkey AS VARCHAR)), 1, 15) < '800000000000000'"


@register("linreg", f"""
WITH o AS (SELECT o_orderkey, o_totalprice, o_custkey, CAST(dayofyear(o_orderdate) AS INTEGER) AS day FROM orders),
train AS (SELECT * FROM o WHERE {_SPLIT_SQL}),"""
          + _ols_ctes("train", "o_totalprice", "o_custkey", "day") + f"""
SELECT o_orderkey, round(o_totalprice, 2) AS label, round(b0 + b1 * o_custkey + b2 * day, 2) AS prediction
FROM o, e WHERE NOT {_SPLIT_SQL}""")
def q_linreg(spark, base):
    """Fit on the hash-split training side, predict the other side; orders have a unique key."""
    o = read_table(spark, base, "orders", ["o_orderkey", "o_totalprice", "o_custkey", "o_orderdate"])
    o = o.select("o_orderkey", "o_totalprice", "o_custkey", F.dayofyear("o_orderdate").alias("day"))
    out = M.fit_linear_predict(o, "o_totalprice ~ o_custkey + day", key=["o_orderkey"], seed=1099)
    return out.select("o_orderkey", F.round("label", 2).alias("label"), F.round("prediction", 2).alias("prediction"))


@register("glm_fit", _OLS_SQL + """,
       round((SELECT sigma2 * (n - 3) FROM e) / 1e6, 3) AS deviance,
       round((SELECT n * (ln(2 * pi() * sigma2 * (n - 3) / n) + 1) + 2 + 6 FROM e), 3) AS aic
FROM t""")
def q_glm_fit(spark, base):
    """Gaussian terms, deviance (in millions) and AIC."""
    li = read_table(spark, base, "lineitem", ["l_extendedprice", "l_quantity", "l_discount"])
    out = M.glm_summary(li, "l_extendedprice ~ l_quantity + l_discount")
    return out.select("term", *[F.round(c, 3).alias(c) for c in ("estimate", "std_err", "t_value")],
                      F.round(F.col("deviance") / 1e6, 3).alias("deviance"), F.round("aic", 3).alias("aic"))


_MODEL_TEXT = ("rndrng_prvdr_gndr", "rndrng_prvdr_state_abrvtn", "rndrng_prvdr_ruca")
_MODEL_TERMS_SQL = "\nUNION ALL ".join(
    [f"SELECT '{c}_' || {c} AS term, count(*)::DOUBLE AS total, count(*) AS n_rows FROM m WHERE {c} IS NOT NULL GROUP BY {c}" for c in _MODEL_TEXT]
    + [f"SELECT '{c}', round(coalesce(sum(\"{c}\"), 0), 3), count(*) FROM m" for c in S.CLAIM_CODES])


@register("formula_features", _FEATURES_SQL + f"""
SELECT term, total, (SELECT count(*) FROM m) AS n_rows FROM ({_MODEL_TERMS_SQL})""")
def q_formula_features(spark, base):
    """Features of ``fraud ~ . - x``, added up for each term."""
    feats = q_provider_features(spark, base)
    data = M.formula_features(feats, "fraud ~ . - rndrng_prvdr_type",
                              drop=["rndrng_npi", "rndrng_prvdr_zip5"])
    return M.feature_sums(data)


@register("logit_label")
def q_logit_label(spark, base):
    feats = q_provider_features(spark, base)
    return M.fit_logistic_predict(feats, "fraud ~ . - rndrng_prvdr_type",
                                drop=["rndrng_npi", "rndrng_prvdr_zip5"])


@register("logit_scores", _FEATURES_SQL + f"""
SELECT term, true AS balanced FROM ({_MODEL_TERMS_SQL}) UNION ALL SELECT '(Intercept)', true""")
def q_logit_scores(spark, base):
    """Score equations of the logistic fit: the weighted residuals of every term sum to zero."""
    feats = q_provider_features(spark, base)
    out = M.logistic_scores(feats, "fraud ~ . - rndrng_prvdr_type",
                            ["rndrng_npi", "rndrng_prvdr_type", "rndrng_prvdr_zip5"])
    return out.select("term", (F.abs("score") <= 0.01 * F.col("scale")).alias("balanced"))


def _physician_model_frame(spark, base):
    ps = PL.physician_subset(_clean(spark, base))
    df = FL.drop_null(ps)
    return df.withColumn("npi_or_upin", F.when(F.col("npi_or_upin") == 1, "present")
                         .otherwise("missing"))


@register("forest_importance")
def q_forest_importance(spark, base):
    """Both importances in long form, variables in the order of the accuracy measure."""
    df = _physician_model_frame(spark, base)
    return FO.importance_long(FO.forest_importances(df, "npi_or_upin", ["identifier"], seed=1099))


@register("permutation_importance")
def q_permutation_importance(spark, base):
    """Out-of-bag importances, one row a variable."""
    df = _physician_model_frame(spark, base)
    return FO.forest_importances(df, "npi_or_upin", ["identifier"], seed=1099)


_FACTORS = ("o_orderpriority", "o_orderstatus")


def _factor_sql(c: str) -> str:
    """Mean label of the row's level over the other folds, drawn to their overall mean."""
    level = f"PARTITION BY coalesce({c}, '')"
    return (f"round((coalesce(sum(y) OVER ({level}), 0) - coalesce(sum(y) OVER ({level}, fold), 0)"
            f" + 10 * (sum(y) OVER () - sum(y) OVER (PARTITION BY fold)) / (count(*) OVER () - count(*) OVER (PARTITION BY fold)))"
            f" / (count(*) OVER ({level}) - count(*) OVER ({level}, fold) + 10), 6) AS {c}")


@register("factor_encoding", f"""
WITH o AS (
  SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y, o_orderpriority, o_orderstatus,
         CAST('0x' || substr(md5('7:|' || o_orderkey), 1, 8) AS BIGINT) % 5 AS fold
  FROM orders
)
SELECT o_orderkey, {", ".join(map(_factor_sql, _FACTORS))} FROM o""")
def q_factor_encoding(spark, base):
    """Out-of-fold factor encoding of orders: no row's own label enters."""
    o = read_table(spark, base, "orders", ["o_orderkey", "o_totalprice", *_FACTORS])
    o = o.withColumn("y", (F.col("o_totalprice") > 150000).cast("double"))
    out = FO.encode_factors(o, _FACTORS, "y", ["o_orderkey"], seed=7)
    return out.select("o_orderkey", *[r6(c).alias(c) for c in _FACTORS])


# --- features and fits on any number of codes ----------------------------------------

@register("code_vectors", with_ctes(*EXCL_BASE, CLAIMS_CTE) + _CC_CTE + f"""
, v AS (SELECT {_PROVIDER_KEYS_SQL}, coalesce(hcpcs_cd, 'NA') AS code, avg(srvcs_per_bene) AS mean FROM cc GROUP BY ALL)
, i AS (SELECT code, row_number() OVER (ORDER BY code) - 1 AS idx FROM (SELECT DISTINCT code FROM v))
, m AS (SELECT {_PROVIDER_KEYS_SQL}, count(mean) FILTER (WHERE mean <> 0) AS n_codes,
               coalesce(sum(idx) FILTER (WHERE mean <> 0), 0)::BIGINT AS sum_index,
               round(coalesce(sum((idx + 1) * mean), 0), 4) AS weighted FROM v JOIN i USING (code) GROUP BY ALL)
SELECT m.*, {_FRAUD_SQL} FROM m""")
def q_code_vectors(spark, base):
    """Each provider's sparse vector over the dense index of codes: places and values."""
    out, _ = PL.provider_features_vector(_claims(spark, base), _clean(spark, base))
    e = SP.vector_entries("codes")
    return out.select(*PL.PROVIDER_KEYS, F.size(e).cast("long").alias("n_codes"),
                      F.aggregate(e, F.lit(0).cast("long"), lambda a, x: a + x["index"]).alias("sum_index"),
                      F.round(F.aggregate(e, F.lit(0.0), lambda a, x: a + (x["index"] + 1) * x["value"]), 4).alias("weighted"), "fraud")


def _newton_sql(ctes: str, source: str, y: str, x1: str, x2: str, weight: str = "1.0", steps: int = 9) -> str:
    """Newton's steps of a two-regressor logistic fit from 0; table ``b`` has the estimates and the
    inverse information."""
    out = f"""{ctes}
d AS MATERIALIZED (SELECT ({y})::DOUBLE AS y, ({x1})::DOUBLE AS x1, ({x2})::DOUBLE AS x2, ({weight})::DOUBLE AS w FROM {source}),
b0 AS (SELECT 0.0::DOUBLE AS c0, 0.0::DOUBLE AS c1, 0.0::DOUBLE AS c2)"""
    for k in range(steps):
        out += f""",
s{k} AS (SELECT c0, c1, c2, sum(w * q) AS a00, sum(w * q * x1) AS a01, sum(w * q * x2) AS a02, sum(w * q * x1 * x1) AS a11,
               sum(w * q * x1 * x2) AS a12, sum(w * q * x2 * x2) AS a22, sum(w * (y - f)) AS g0, sum(w * (y - f) * x1) AS g1, sum(w * (y - f) * x2) AS g2
        FROM (SELECT *, f * (1 - f) AS q FROM (SELECT *, 1 / (1 + exp(-(c0 + c1 * x1 + c2 * x2))) AS f FROM d, b{k})) GROUP BY c0, c1, c2),
i{k} AS (SELECT *, (a11 * a22 - a12 * a12) / det AS i00, (a02 * a12 - a01 * a22) / det AS i01, (a01 * a12 - a02 * a11) / det AS i02,
               (a00 * a22 - a02 * a02) / det AS i11, (a01 * a02 - a00 * a12) / det AS i12, (a00 * a11 - a01 * a01) / det AS i22
        FROM (SELECT *, a00 * (a11 * a22 - a12 * a12) - a01 * (a01 * a22 - a12 * a02) + a02 * (a01 * a12 - a11 * a02) AS det FROM s{k})),
b{k + 1} AS MATERIALIZED (SELECT c0 + i00 * g0 + i01 * g1 + i02 * g2 AS c0, c1 + i01 * g0 + i11 * g1 + i12 * g2 AS c1,
               c2 + i02 * g0 + i12 * g1 + i22 * g2 AS c2, i00, i11, i22 FROM i{k})"""
    return out.replace(f"b{steps} AS", "b AS")


@register("logit_terms", "WITH " + _newton_sql("", "lineitem", "l_extendedprice > 30000", "l_quantity", "l_discount") + """
SELECT term, round(estimate, 4) AS estimate, round(std_err, 4) AS std_err, round(estimate / std_err, 3) AS z_value FROM (
  SELECT 'l_quantity' AS term, c1 AS estimate, sqrt(i11) AS std_err FROM b
  UNION ALL SELECT 'l_discount', c2, sqrt(i22) FROM b
  UNION ALL SELECT '(Intercept)', c0, sqrt(i00) FROM b)""")
def q_logit_terms(spark, base):
    """Coefficient table of a logistic fit: estimates, errors and z by the Fisher information."""
    li = read_table(spark, base, "lineitem", ["l_extendedprice", "l_quantity", "l_discount"])
    li = li.select(F.when(F.col("l_extendedprice") > 30000, "true").otherwise("false").alias("high"), "l_quantity", "l_discount")
    out = M.logistic_terms(li, "high ~ l_quantity + l_discount")
    return out.select("term", F.round("estimate", 4).alias("estimate"), F.round("std_err", 4).alias("std_err"), F.round("z_value", 3).alias("z_value"))


_LOGIT_ORDERS = """
o AS (SELECT o_orderkey, o_totalprice > 300000 AS y, o_custkey / 1000.0 AS x1, dayofyear(o_orderdate) / 100.0 AS x2 FROM orders),
k AS (SELECT *, count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY y)) AS w FROM o),"""


@register("logit_fit", "WITH " + _newton_sql(_LOGIT_ORDERS, "k", "y::INTEGER", "x1", "x2", "w") + """
SELECT o_orderkey, (y::INTEGER)::DOUBLE AS label, round(1 / (1 + exp(-(c0 + c1 * x1 + c2 * x2))), 4) AS p_positive FROM o, b""")
def q_logit_fit(spark, base):
    """Class-weighted logistic predictions, against Newton's steps in SQL."""
    o = read_table(spark, base, "orders", ["o_orderkey", "o_totalprice", "o_custkey", "o_orderdate"])
    o = o.select("o_orderkey", F.when(F.col("o_totalprice") > 300000, "true").otherwise("false").alias("high"),
                 (F.col("o_custkey") / 1000.0).alias("x1"), (F.dayofyear("o_orderdate") / 100.0).alias("x2"))
    out = M.fit_logistic_predict(o, "high ~ x1 + x2", key="o_orderkey", tol=1e-12)
    return out.select("o_orderkey", "label", F.round("p_positive", 4).alias("p_positive"))


# --- many columns -----------------------------------------------------------------------

_WIDE = 60  # columns of the wide matrix; the SQL has those of _WIDE_SUBSET
_WIDE_SUBSET = (0, 7, 23, 41, 59)


def _wide_sql(k: int) -> str:
    return f"CASE WHEN (l_linenumber + {k}) % 5 <> 0 THEN l_quantity * {k % 7} + l_extendedprice * {k % 3} / 1000 + (l_partkey % {k + 2}) + l_tax END"


@register("corr_wide", "WITH w AS (SELECT " + ", ".join(f"{_wide_sql(k)} AS c{k}" for k in _WIDE_SUBSET) + " FROM lineitem)\n" + "\nUNION ALL\n".join(
    f"SELECT 'c{a}' AS x, 'c{b}' AS y, round(corr(c{a}, c{b}), 6) AS r FROM w" for a in _WIDE_SUBSET for b in _WIDE_SUBSET if a > b))
def q_corr_wide(spark, base):
    """Pairwise complete correlation of many columns with gaps, by blocked moments."""
    li = read_table(spark, base, "lineitem", ["l_linenumber", "l_quantity", "l_extendedprice", "l_partkey", "l_tax"])
    wide = li.select(*[F.when((F.col("l_linenumber") + k) % 5 != 0, F.col("l_quantity") * (k % 7) + F.col("l_extendedprice") * (k % 3) / 1000
                              + (F.col("l_partkey") % (k + 2)) + F.col("l_tax")).alias(f"c{k}") for k in range(_WIDE)])
    kept = [f"c{k}" for k in _WIDE_SUBSET]
    return P.corr_blocks(wide, wide.columns).where(F.col("x").isin(kept) & F.col("y").isin(kept)).withColumn("r", r6("r"))


# --- label join beyond the plain one --------------------------------------------------------

@register("label_bloom", ORACLE["labelled_claims"])
def q_label_bloom(spark, base):
    """The mandatory label with a Bloom filter of the list at the claim scan."""
    lines = _claims(spark, base).select("rndrng_npi", "rndrng_prvdr_type", "place_of_srvc", "hcpcs_cd", "tot_srvcs")
    return label_by_bloom(lines, C.mandatory_npis(_raw(spark, base)), "rndrng_npi")


@register("claim_store", with_ctes(*EXCL_BASE[:2], CLAIMS_CTE, MANDATORY_CTE) + """
SELECT year, fraud, count(*) AS n, round(sum(tot_srvcs), 6) AS tot_srvcs FROM (
  SELECT c.*, CASE WHEN EXISTS (SELECT 1 FROM mandatory m WHERE m.rndrng_npi = c.rndrng_npi) THEN 'yes' ELSE 'no' END AS fraud
  FROM claims c WHERE year >= 1997) GROUP BY year, fraud""")
def q_claim_store(spark, base):
    """Claims stored by year and provider bucket, labelled without a shuffle of either side."""
    lines = _claims(spark, base)
    buckets = store.bucket_count(lines)
    claims = store.write_claim_store(lines, store.table_name("claims"), scratch_path(spark, "claim-store"), buckets=buckets)
    listed = store.write_member_store(C.mandatory_npis(_raw(spark, base)), store.table_name("listed"), scratch_path(spark, "list-store"),
                                      "rndrng_npi", buckets=buckets)
    lab = store.label_from_store(claims.where(F.col("year") >= 1997), listed)
    return lab.groupBy("year", "fraud").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("tot_srvcs")).alias("tot_srvcs"))


# --- mergeable sketches ---------------------------------------------------------------------

@register("distinct_sketch", with_ctes(CLAIMS_CTE) + """
SELECT rndrng_prvdr_type, rndrng_prvdr_state_abrvtn, count(*) AS n_rows, count(*) FILTER (WHERE hcpcs_cd IS NULL) AS n_missing,
       count(DISTINCT hcpcs_cd) + CAST(bool_or(hcpcs_cd IS NULL) AS INTEGER) AS n_unique
FROM claims GROUP BY 1, 2""")
def q_distinct_sketch(spark, base):
    """Codes billed by type and state, from a sketch for each year's load; few codes are counted exactly."""
    keys = ["rndrng_prvdr_type", "rndrng_prvdr_state_abrvtn"]
    loads = SK.distinct_sketches(_claims(spark, base), ["year", *keys], ["hcpcs_cd"])
    return SK.merged_distinct(loads, keys, count_null=True).drop("column")


_SKETCHED = ("o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice")


@register("profile_sketch", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS n_unique, true AS within FROM orders"
    for c in _SKETCHED))
def q_profile_sketch(spark, base):
    """Column profile merged from monthly sketches: the estimates lie within 4 % of the exact counts."""
    o = read_table(spark, base, "orders", [*_SKETCHED, "o_orderdate"])
    loads = SK.distinct_sketches(o, [F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month")], _SKETCHED)
    merged = SK.merged_distinct(loads, [])
    exact = P.profile_columns(o.select(*[F.col(c).cast("string") for c in _SKETCHED])).select("skim_variable", F.col("character_n_unique").alias("exact"))
    out = merged.join(exact, F.col("column") == F.col("skim_variable"))
    return out.select("column", "n_rows", "n_missing", F.col("exact").alias("n_unique"),
                      (F.abs(F.col("n_unique") - F.col("exact")) <= 0.04 * F.col("exact")).alias("within"))


@register("quantile_sketch", """
SELECT l_returnflag, unnest([0.25, 0.5, 0.75]::DOUBLE[]) AS p, count(*) AS n, true AS within FROM lineitem GROUP BY l_returnflag""")
def q_quantile_sketch(spark, base):
    """Quartiles of the price by flag, merged from monthly sketches: ranks within 1.5 % of the exact ones."""
    li = read_table(spark, base, "lineitem", ["l_returnflag", "l_extendedprice", "l_shipdate"])
    loads = SK.quantile_sketches(li, ["l_returnflag", F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month")], "l_extendedprice")
    merged = SK.merged_quantiles(loads, ["l_returnflag"], [0.25, 0.5, 0.75])
    errors = SK.rank_errors(li, ["l_returnflag"], "l_extendedprice", merged)
    return errors.select("l_returnflag", "p", "n", (F.col("error") <= 0.015).alias("within"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
