"""Stand-ins: the driver's tables re-shaped into the study's input schemas.

The study's inputs (the federal exclusion list, Part B claims, state lists)
are not shipped, so every registered query reads the driver tables and
re-shapes them with the rules below.  These are our own choices, chosen to
exercise every null rule and category the operators handle; the same rules
are written independently in SQL in ``provguard.plans.oracle``.

* exclusion list  <- orders x customer: one exclusion per order, the
  customer is the excluded person (NPI = customer key for one in three).
* claims          <- lineitem x part x supplier: the supplier is the
  rendering provider, the part brand the procedure code, the return flag
  the place of service.
* state lists     <- lineitem (CA), finished orders (TX), all other orders (NY).
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provguard.sources.tables import read_table

# --- stand-in values (ours, not the study's) ----------------------------------
# State of each nation key 0..24 (the last nation has no state).
NATION_STATES = (
    "CA", "NY", "TX", "FL", "IL", "PA", "OH", "GA", "NC", "MI", "NJ", "VA", "WA",
    "AZ", "MA", "TN", "IN", "MO", "MD", "WI", "DC", "PR", "VI", "GU", None,
)
# Profession by 10 - floor(sqrt(custkey % 100)): the first is the most common.
PROFESSIONS = (
    "MEDICAL PRACTICE, MD", "PHYSICIAN (MD, DO)", "NURSING PROFESSION", "PHARMACY",
    "BUSINESS OWNER/EXEC", "DENTAL PRACTICE", "CHIROPRACTIC PRACTICE",
    "PODIATRIC PRACTICE", "OPTOMETRIC PRACTICE", "OTHER BUSINESS",
)
# Specialty by orderkey % 14 (the empty text is a null token).
SPECIALTIES = (
    "FAMILY PRACTICE", "INTERNAL MEDICINE", "GENERAL PRACTICE/FP", "PSYCHIATRY",
    "ANESTHESIOLOGY", "PAIN MANAGEMENT", "CARDIOLOGY", "SOCIAL WORKER", "SOCIAL_WORKER",
    "TECHNICIAN", "EMPLOYEE", "NURSE/NURSES AIDE", "GENERAL PRACTICE", "",
)
# Statute code by floor(sqrt(orderkey % 625)): entry i has weight 2i+1, so the
# list runs from rarest to most common.
EXCLTYPE_CYCLE = (
    "", "1160", "BRCH SA", "BRCH CIA", "1128Aa", "1128b12", "1128b16", "1128b11",
    "1128b15", "1156", "1128b2", "1128b6", "1128b3", "1128b7", "1128b5", "1128b1",
    "1128b8", "1128b14", "1128a4", "1128a3", "1128a2", "1128b9", "1128b10", "1128a1",
    "1128b4",
)
# Part brands stand for procedure codes (lines of some parts have none), return flags for places.
CLAIM_CODES = tuple(f"Brand#{k}" for k in range(1, 26)) + ("NA",)
CLAIM_PLACES = ("A", "N", "R")
PROVIDER_TYPES = ("Internal Medicine", "Family Practice", "Cardiology", "Nurse Practitioner")

# The stand-in list runs 1995-01 to 2001-08: keep full years only.
EXCLUSION_CUTOFF = "2001-01-01"
# State-list comparison starts here (the study used 1972 on real data).
STATE_LIST_START = "1996-01-01"


def _array_literal(values) -> Column:
    """A constant string array (one expression; folded by the optimizer)."""
    items = ", ".join("NULL" if v is None else "'" + v.replace("'", "\\'") + "'"
                      for v in values)
    return F.expr(f"array({items})")


def _pick(values, index: Column) -> Column:
    """``values[index]`` with a 1-based index."""
    return F.element_at(_array_literal(values), index.cast("int"))


def _s(c: Column) -> Column:
    return c.cast("string")


def exclusion_raw(spark: SparkSession, base: str) -> DataFrame:
    """The raw exclusion list: 18 text columns, tokens for missing values."""
    o = read_table(spark, base, "orders",
                   ["o_orderkey", "o_custkey", "o_orderdate"])
    c = read_table(spark, base, "customer", ["c_custkey", "c_name", "c_nationkey"])
    j = o.join(c, o.o_custkey == c.c_custkey, "left")
    k, cu = F.col("o_orderkey"), F.col("o_custkey")
    entity = (cu % 9) == 0
    tok = F.lit("")
    return j.select(
        F.when(entity, tok).otherwise(F.concat(F.lit("LN"), _s(cu))).alias("lastname"),
        F.when(entity, tok).otherwise(F.concat(F.lit("FN"), _s(cu % 97))).alias("firstname"),
        F.when((cu % 2) == 0, F.lit("M")).otherwise(tok).alias("midname"),
        F.when(entity, F.col("c_name")).otherwise(tok).alias("busname"),
        _pick(PROFESSIONS, F.lit(10) - F.floor(F.sqrt(cu % 100))).alias("general"),
        _pick(SPECIALTIES, (k % 14) + 1).alias("specialty"),
        F.when((cu % 4) == 0, F.concat(F.lit("U"), _s(cu))).otherwise(tok).alias("upin"),
        F.when((cu % 3) == 0, _s(cu)).otherwise(F.lit("0000000000")).alias("npi"),
        F.when((cu % 11) == 0, F.lit("00000000"))
         .otherwise(F.concat(_s(F.lit(1930) + cu % 45), F.lit("0615"))).alias("dob"),
        F.concat(_s(cu), F.lit(" MAIN ST")).alias("address"),
        F.concat(F.lit("CITY"), _s(cu % 50)).alias("city"),
        _pick(NATION_STATES, F.col("c_nationkey") + 1).alias("state"),
        F.lpad(_s(cu % 100000), 5, "0").alias("zip"),
        _pick(EXCLTYPE_CYCLE, F.floor(F.sqrt(k % 625)) + 1).alias("excltype"),
        F.when((k % 101) == 0, F.lit("00000000"))
         .otherwise(F.date_format(F.col("o_orderdate").cast("date"), "yyyyMMdd"))
         .alias("excldate"),
        F.when((k % 97) == 5, F.lit("20020101")).otherwise(tok).alias("reindate"),
        F.when((k % 89) == 7, F.lit("20030301")).otherwise(tok).alias("waiverdate"),
        F.when((k % 89) == 7, F.lit("NY")).otherwise(tok).alias("wvrstate"),
    )


def claims(spark: SparkSession, base: str, year: int | None = None) -> DataFrame:
    """Part B style claim lines: provider x code x place of service.

    ``year`` keeps one claim year with a ship-date range on the scan (pushed
    to Parquet row-group statistics), like reading one yearly file.
    """
    li = read_table(spark, base, "lineitem",
                    ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                     "l_returnflag", "l_shipdate"])
    if year is not None:
        # Wall-clock bounds of the same type as the column: no time zone enters.
        d = F.col("l_shipdate")
        lo = F.lit(f"{year}-01-01 00:00:00").cast("timestamp_ntz")
        hi = F.lit(f"{year + 1}-01-01 00:00:00").cast("timestamp_ntz")
        li = li.where((d >= lo) & (d < hi))
    p = read_table(spark, base, "part", ["p_partkey", "p_brand"])
    s = read_table(spark, base, "supplier", ["s_suppkey", "s_nationkey"])
    j = (li.join(p, li.l_partkey == p.p_partkey, "left")
         .join(s, li.l_suppkey == s.s_suppkey, "left"))
    sk = F.col("s_suppkey")
    return j.select(
        _s(F.col("l_suppkey")).alias("rndrng_npi"),
        _pick(PROVIDER_TYPES, (sk % 4) + 1).alias("rndrng_prvdr_type"),
        F.when((sk % 2) == 0, F.lit("F")).otherwise(F.lit("M")).alias("rndrng_prvdr_gndr"),
        _pick(NATION_STATES, F.col("s_nationkey") + 1).alias("rndrng_prvdr_state_abrvtn"),
        F.lpad(_s((sk * 37) % 100000), 5, "0").alias("rndrng_prvdr_zip5"),
        _s((sk % 10) + 1).alias("rndrng_prvdr_ruca"),
        F.when((sk % 13) == 0, F.lit("N")).otherwise(F.lit("Y"))
         .alias("rndrng_prvdr_mdcr_prtcptg_ind"),
        F.when((F.col("l_partkey") % 41) != 7, F.col("p_brand")).alias("hcpcs_cd"),
        F.col("l_returnflag").alias("place_of_srvc"),
        F.col("l_quantity").cast("double").alias("tot_srvcs"),
        (F.col("l_linenumber") % 7).cast("long").alias("tot_benes"),
        F.year("l_shipdate").alias("year"),
    )


def statute_lookup(spark: SparkSession) -> DataFrame:
    """The 25-row statute lookup as a table (small, fixed size)."""
    from provguard.fixed import STATUTE_LOOKUP
    return spark.createDataFrame(
        list(STATUTE_LOOKUP),
        "statute string, agency string, exclusion string, description string")


def state_list_ca(spark: SparkSession, base: str) -> DataFrame:
    """California list: text dates ``M/d/yyyy``, ``N/A`` for missing."""
    li = read_table(spark, base, "lineitem", ["l_orderkey", "l_shipdate"])
    return li.select(
        F.when((F.col("l_orderkey") % 50) == 0, F.lit("N/A"))
         .otherwise(F.date_format(F.col("l_shipdate").cast("date"), "M/d/yyyy"))
         .alias("Date of Suspension"),
        F.concat(F.lit("ORD"), _s(F.col("l_orderkey"))).alias(
            "A.K.A.(also known as)/D.B.A.(doing business as)"),
    )


def state_list_ny(spark: SparkSession, base: str) -> DataFrame:
    """New York list: text dates ``M/d/yyyy``."""
    o = read_table(spark, base, "orders", ["o_orderkey", "o_orderstatus", "o_orderdate"])
    return o.where(F.col("o_orderstatus") != "F").select(
        F.col("o_orderkey").alias("provider_id"),
        F.date_format(F.col("o_orderdate").cast("date"), "M/d/yyyy")
         .alias("exclusion_effective_date"))


def state_list_tx(spark: SparkSession, base: str) -> DataFrame:
    """Texas list: date-times."""
    o = read_table(spark, base, "orders", ["o_orderkey", "o_orderstatus", "o_orderdate"])
    return o.where(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("provider_id"), F.col("o_orderdate").alias("StartDate"))
