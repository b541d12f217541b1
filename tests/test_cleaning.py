"""Exclusion-list cleaning (X01) on hand-made edge rows, and the golden table."""

import datetime as dt

from pyspark.sql import functions as F

from provguard.fixed import EXCLUSION_COLUMNS, GOLDEN_STATUTE_COUNTS
from provguard.plans import cleaning as C
from provguard.plans import pipelines as PL
from provguard.plans import standins as S

BASE = dict(lastname="DOE", firstname="JO", midname="", busname="", general="PHYSICIAN (MD, DO)",
            specialty="FAMILY PRACTICE", upin="", npi="1234567890", dob="19600101",
            address="1 A ST", city="X", state="CA", zip="90001", excltype="1128a1",
            excldate="20200105", reindate="00000000", waiverdate="00000000", wvrstate="")


def raw_rows(spark, *overrides):
    rows = []
    for i, o in enumerate(overrides):
        r = dict(BASE, **o)
        r.setdefault("address", f"{i}")
        rows.append(tuple(r[c] for c in EXCLUSION_COLUMNS))
    schema = ", ".join(f"{c.upper()} string" for c in EXCLUSION_COLUMNS)  # mixed-case headers
    return spark.createDataFrame(rows, schema)


def test_clean_rules(spark):
    raw = raw_rows(
        spark,
        {"address": "keep"},
        {"address": "entity", "lastname": ""},
        {"address": "nodate", "excldate": "00000000"},
        {"address": "lastday", "excldate": "20221231"},
        {"address": "cutoff", "excldate": "20230101"},
        {"address": "reinstated", "reindate": "20210101"},
        {"address": "waived", "waiverdate": "20210101"},
        {"address": "nullcode", "excltype": ""},
        {"address": "u1", "excltype": "1128Aa"},
        {"address": "u2", "excltype": "BRCH CIA"},
        {"address": "u3", "excltype": "BRCH SA"},
        {"address": "u4", "excltype": "1160"},
        {"address": "code1156", "excltype": "1156"},
        {"address": "perm", "excltype": "1128b4"},
        {"address": "nodob", "dob": "00000000"},
        {"address": "badtext", "dob": "19601399"},
    )
    out = {r["address"]: r for r in C.clean_exclusions(raw).collect()}
    assert set(out) == {"keep", "entity", "lastday", "nullcode", "code1156", "perm", "nodob",
                        "badtext"}
    assert out["keep"]["type"] == "Individual" and out["entity"]["type"] == "Entity"
    assert out["keep"]["exclusion"] == "mandatory"
    assert out["perm"]["exclusion"] == "permissive"
    assert out["code1156"]["exclusion"] == "other"
    assert out["nullcode"]["excltype"] is None and out["nullcode"]["exclusion"] == "other"
    assert out["keep"]["age_at_excl"] == 60
    assert out["nodob"]["dob"] is None and out["nodob"]["age_at_excl"] is None
    assert out["badtext"]["dob"] is None
    assert out["lastday"]["excldate"] == dt.date(2022, 12, 31)
    assert out["keep"]["upin"] is None and out["keep"]["reindate"] is None


def test_zero_token_and_headers(spark):
    raw = raw_rows(spark, {"npi": "0"}, {"npi": "0000000000", "address": "b"})
    df = C.tokens_to_null(raw)
    assert df.columns == list(EXCLUSION_COLUMNS)
    assert [r["npi"] for r in df.collect()] == [None, None]


def test_mandatory_npis(spark):
    raw = raw_rows(spark, {"npi": "1"}, {"npi": "1", "address": "dup"},
                   {"npi": "2", "excltype": "1128b4"}, {"npi": "0000000000"},
                   {"npi": "3", "excltype": "1128Aa"})
    got = sorted(r["rndrng_npi"] for r in C.mandatory_npis(raw).collect())
    assert got == ["1", "1"]


def test_physician_subset_rules(spark):
    raw = raw_rows(
        spark,
        {"address": "md", "general": "MEDICAL PRACTICE, MD", "specialty": "PSYCHIATRY"},
        {"address": "sw1", "specialty": "SOCIAL WORKER"},
        {"address": "sw2", "specialty": "SOCIAL_WORKER"},
        {"address": "nospec", "specialty": ""},
        {"address": "nurse", "general": "NURSING PROFESSION"},
        {"address": "perm", "excltype": "1128b4"},
        {"address": "entity", "lastname": ""},
        {"address": "noid", "npi": "0000000000", "upin": ""},
        {"address": "upinonly", "npi": "0000000000", "upin": "A1"},
    )
    out = PL.physician_subset(C.clean_exclusions(raw)).collect()
    assert len(out) == 4  # md, nospec, noid, upinonly
    assert sorted(r["identifier"] for r in out) == [1, 2, 3, 4]
    flags = sorted(r["npi_or_upin"] for r in out)
    assert flags == [0, 1, 1, 1]


def test_golden_statute_table(spark):
    """The one published output: 18 statutes with counts, largest first."""
    counts = spark.createDataFrame(list(GOLDEN_STATUTE_COUNTS), "excltype string, n long")
    clean = counts.select("excltype", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_i"))
    out = PL.statute_counts(clean, S.statute_lookup(spark)).collect()
    assert [(r["statute"], r["n_count"]) for r in out] == list(GOLDEN_STATUTE_COUNTS)
    assert sum(r["n_count"] for r in out) == 76382
    assert out[0]["description"] == "License revocation or suspension"
    assert out[13]["exclusion"] == "unknown"
    assert {r["agency"] for r in out} == {"Social Security"}
    mandatory = sum(r["n_count"] for r in out if r["exclusion"] == "Mandatory")
    assert mandatory == 38685


def test_state_list_years(spark):
    df = spark.createDataFrame([("3/7/1971",), ("3/7/1980",), ("12/31/1980",), ("N/A",)],
                               "d string")
    out = C.state_list_years(df, "d", "ca_hhs", "M/d/yyyy", null_token="N/A",
                             start="1972-01-01").collect()
    assert [(r["year"], r["n"], r["agency"]) for r in out] == [(dt.date(1980, 1, 1), 2, "ca_hhs")]
