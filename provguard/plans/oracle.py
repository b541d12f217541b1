"""SQL for the DuckDB oracle: the stand-ins and cleaning written in SQL.

These common table expressions restate, in plain SQL, the rules that
``provguard.plans.standins`` and ``provguard.plans.cleaning`` implement with
the DataFrame API; each oracle query in the catalog starts from them.  Only
the value lists are shared with the Python side (as SQL list literals).
"""

from __future__ import annotations

from provguard.fixed import EXCLUSION_COLUMNS, NULL_TOKENS, STATUTE_LOOKUP, UNITEMISED_CODES
from provguard.plans.standins import (EXCLTYPE_CYCLE, EXCLUSION_CUTOFF, NATION_STATES,
                                      PROFESSIONS, PROVIDER_TYPES, SPECIALTIES)


def q(v) -> str:
    """SQL literal."""
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v)


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def sql_in(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


STATUTE_VALUES = ",\n    ".join(
    "(" + ", ".join(q(v) for v in row) + ")" for row in STATUTE_LOOKUP)

STATUTE_CTE = f"""statute_lookup(statute, agency, exclusion, description) AS (
  VALUES
    {STATUTE_VALUES}
)"""

EXCL_RAW_CTE = f"""excl_raw AS (
  SELECT
    CASE WHEN o.o_custkey % 9 = 0 THEN '' ELSE 'LN' || CAST(o.o_custkey AS VARCHAR) END AS lastname,
    CASE WHEN o.o_custkey % 9 = 0 THEN '' ELSE 'FN' || CAST(o.o_custkey % 97 AS VARCHAR) END AS firstname,
    CASE WHEN o.o_custkey % 2 = 0 THEN 'M' ELSE '' END AS midname,
    CASE WHEN o.o_custkey % 9 = 0 THEN c.c_name ELSE '' END AS busname,
    {sql_list(PROFESSIONS)}[CAST(10 - floor(sqrt(o.o_custkey % 100)) AS INTEGER)] AS general,
    {sql_list(SPECIALTIES)}[CAST(o.o_orderkey % 14 + 1 AS INTEGER)] AS specialty,
    CASE WHEN o.o_custkey % 4 = 0 THEN 'U' || CAST(o.o_custkey AS VARCHAR) ELSE '' END AS upin,
    CASE WHEN o.o_custkey % 3 = 0 THEN CAST(o.o_custkey AS VARCHAR) ELSE '0000000000' END AS npi,
    CASE WHEN o.o_custkey % 11 = 0 THEN '00000000'
         ELSE CAST(1930 + o.o_custkey % 45 AS VARCHAR) || '0615' END AS dob,
    CAST(o.o_custkey AS VARCHAR) || ' MAIN ST' AS address,
    'CITY' || CAST(o.o_custkey % 50 AS VARCHAR) AS city,
    {sql_list(NATION_STATES)}[CAST(c.c_nationkey + 1 AS INTEGER)] AS state,
    lpad(CAST(o.o_custkey % 100000 AS VARCHAR), 5, '0') AS zip,
    {sql_list(EXCLTYPE_CYCLE)}[CAST(floor(sqrt(o.o_orderkey % 625)) + 1 AS INTEGER)] AS excltype,
    CASE WHEN o.o_orderkey % 101 = 0 THEN '00000000' ELSE strftime(o.o_orderdate, '%Y%m%d') END AS excldate,
    CASE WHEN o.o_orderkey % 97 = 5 THEN '20020101' ELSE '' END AS reindate,
    CASE WHEN o.o_orderkey % 89 = 7 THEN '20030301' ELSE '' END AS waiverdate,
    CASE WHEN o.o_orderkey % 89 = 7 THEN 'NY' ELSE '' END AS wvrstate
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
)"""

_TOKENS = sql_in(NULL_TOKENS)
EXCL_TOK_CTE = "excl_tok AS (\n  SELECT\n" + ",\n".join(
    f"    CASE WHEN {c} IN {_TOKENS} THEN NULL ELSE {c} END AS {c}"
    for c in EXCLUSION_COLUMNS) + "\n  FROM excl_raw\n)"

EXCL_CTE = f"""excl AS (
  SELECT lastname, firstname, midname, busname, general, specialty, upin, npi,
         CAST(try_strptime(dob, '%Y%m%d') AS DATE) AS dob,
         address, city, state, zip, excltype,
         CAST(try_strptime(excldate, '%Y%m%d') AS DATE) AS excldate,
         reindate, waiverdate, wvrstate,
         CASE WHEN lastname IS NULL THEN 'Entity' ELSE 'Individual' END AS type,
         CASE WHEN coalesce(contains(excltype, 'a'), false) THEN 'mandatory'
              WHEN coalesce(contains(excltype, 'b'), false) THEN 'permissive'
              ELSE 'other' END AS exclusion,
         CAST(year(CAST(try_strptime(excldate, '%Y%m%d') AS DATE))
              - year(CAST(try_strptime(dob, '%Y%m%d') AS DATE)) AS BIGINT) AS age_at_excl
  FROM excl_tok
  WHERE CAST(try_strptime(excldate, '%Y%m%d') AS DATE) < DATE '{EXCLUSION_CUTOFF}'
    AND reindate IS NULL AND waiverdate IS NULL
    AND NOT coalesce(excltype IN {sql_in(UNITEMISED_CODES)}, false)
)"""

CLAIMS_CTE = f"""claims AS (
  SELECT
    CAST(l.l_suppkey AS VARCHAR) AS rndrng_npi,
    {sql_list(PROVIDER_TYPES)}[CAST(s.s_suppkey % 4 + 1 AS INTEGER)] AS rndrng_prvdr_type,
    CASE WHEN s.s_suppkey % 2 = 0 THEN 'F' ELSE 'M' END AS rndrng_prvdr_gndr,
    {sql_list(NATION_STATES)}[CAST(s.s_nationkey + 1 AS INTEGER)] AS rndrng_prvdr_state_abrvtn,
    lpad(CAST((s.s_suppkey * 37) % 100000 AS VARCHAR), 5, '0') AS rndrng_prvdr_zip5,
    CAST(s.s_suppkey % 10 + 1 AS VARCHAR) AS rndrng_prvdr_ruca,
    CASE WHEN s.s_suppkey % 13 = 0 THEN 'N' ELSE 'Y' END AS rndrng_prvdr_mdcr_prtcptg_ind,
    CASE WHEN l.l_partkey % 41 <> 7 THEN p.p_brand END AS hcpcs_cd,
    l.l_returnflag AS place_of_srvc,
    CAST(l.l_quantity AS DOUBLE) AS tot_srvcs,
    CAST(l.l_linenumber % 7 AS BIGINT) AS tot_benes,
    CAST(year(l.l_shipdate) AS INTEGER) AS year
  FROM lineitem l
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
  LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
)"""

MANDATORY_CTE = f"""mandatory AS (
  SELECT DISTINCT npi AS rndrng_npi
  FROM excl_tok
  WHERE NOT coalesce(excltype IN {sql_in(UNITEMISED_CODES)}, false)
    AND coalesce(contains(excltype, 'a'), false)
    AND npi IS NOT NULL
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


EXCL_BASE = (EXCL_RAW_CTE, EXCL_TOK_CTE, EXCL_CTE)
