"""Fixed values.

The values below must equal the published study's values for results to
match (null tokens, excluded statute codes, profession lists, the statute
lookup).  They are stated plainly and in their natural order.  Values that
are our own (the stand-in mapping of the driver tables) live in
``provguard.plans.standins``.
"""

from __future__ import annotations

# --- fixed values: exclusion-list scan --------------------------------------
# Tokens that mean "missing" in the raw exclusion list.
NULL_TOKENS = ("00000000", "0000000000", "0", "")

# Token that means "missing" in the California state list.

# Headers of the raw exclusion list, in file order (18 text columns).
EXCLUSION_COLUMNS = (
    "lastname", "firstname", "midname", "busname", "general", "specialty",
    "upin", "npi", "dob", "address", "city", "state", "zip", "excltype",
    "excldate", "reindate", "waiverdate", "wvrstate",
)

# --- fixed values: cleaning rules --------------------------------------------
# Statute codes that are not itemised and are dropped from the clean list.
UNITEMISED_CODES = ("1128Aa", "BRCH CIA", "BRCH SA", "1160")

# Professions that mean "physician".
PHYSICIAN_GENERALS = ("MEDICAL PRACTICE, MD", "PHYSICIAN (MD, DO)")

# Specialties that are not physician jobs.  The study spells social worker
# two ways in two places; both spellings are kept in one list.
NON_PHYSICIAN_SPECIALTIES = (
    "TECHNICIAN", "SOCIAL_WORKER", "SOCIAL WORKER", "NURSE/NURSES AIDE",
    "CLERK/OTHER CLERICAL", "BUSINESS MANAGER", "OWNER/OPERATOR", "EMPLOYEE",
)

# Specialty list of the M.D. specialty chart; the study adds NA to it, so
# null specialties are dropped there (null-dropping NOT IN).
OTHER_JOBS = (
    "NURSE/NURSES AIDE", "EMPLOYEE", "TECHNICIAN", "BUSINESS MANAGER",
    "CLERK/OTHER CLERICAL", "SOCIAL WORKER",
)

# Label rewrite used before counting specialties.
SPECIALTY_REWRITE = ("GENERAL PRACTICE/FP", "GENERAL PRACTICE")

# Territories left out of the per-state completion charts.
TERRITORIES_2000 = ("DC", "VI", "XX", "FM", "GU", "MP", "PR", "AE")
TERRITORIES_2021 = ("DC", "PR")

# Agency labels of the federal-against-state comparison.

# --- fixed values: statute lookup (statute, agency, exclusion, description) ---
STATUTE_LOOKUP = (
    ("1128a1", "Social Security", "Mandatory", "Conviction of program related crimes"),
    ("1128a2", "Social Security", "Mandatory", "Conviction for patient abuse"),
    ("1128a3", "Social Security", "Mandatory", "Felony conviction for healthcare fraud"),
    ("1128a4", "Social Security", "Mandatory", "Felony conviction for controlled substance"),
    ("1128Aa", "Social Security", None, None),
    ("1128b1", "Social Security", "Permissive", "Conviction for misdemeanor fraud"),
    ("1128b2", "Social Security", "Permissive", "Conviction for obstruction of an investigation"),
    ("1128b3", "Social Security", "Permissive", "Conviction for misdemeanor controlled substance"),
    ("1128b4", "Social Security", "Permissive", "License revocation or suspension"),
    ("1128b5", "Social Security", "Permissive", "Suspension under federal or state health care program"),
    ("1128b6", "Social Security", "Permissive", "Claim for excessive charges"),
    ("1128b7", "Social Security", "Permissive", "Fraud or kickbacks or other prohibited"),
    ("1128b8", "Social Security", "Permissive", "Entities controlled by sanctioned individual"),
    ("1128b9", "Social Security", "Permissive", "Failure to disclose required information"),
    ("1128b10", "Social Security", "Permissive", "Failure to supply contractor information"),
    ("1128b11", "Social Security", "Permissive", "Failure to supply payment information"),
    ("1128b12", "Social Security", "Permissive", "Failure to grant immediate access"),
    ("1128b13", "Social Security", "Permissive", "Failure to take corrective action"),
    ("1128b14", "Social Security", "Permissive", "Default on student loans or scholarships"),
    ("1128b15", "Social Security", "Permissive", "Individuals controlled by a sanctioned entity"),
    ("1128b16", "Social Security", "Permissive", "Making a false statement of material fact"),
    ("1156", "Social Security", "unknown", "Services are not economical & medically necessary"),
    ("1160", None, None, None),
    ("BRCH CIA", None, None, None),
    ("BRCH SA", None, None, None),
)

# --- fixed values: golden statute counts (clean list, in printed order) ------
GOLDEN_STATUTE_COUNTS = (
    ("1128b4", 31084), ("1128a1", 23109), ("1128a2", 7449), ("1128a3", 4987),
    ("1128a4", 3140), ("1128b14", 2227), ("1128b8", 1494), ("1128b1", 861),
    ("1128b5", 802), ("1128b7", 683), ("1128b3", 316), ("1128b6", 67),
    ("1128b2", 59), ("1156", 56), ("1128b15", 34), ("1128b11", 11),
    ("1128b16", 2), ("1128b12", 1),
)

# --- fixed values: public R constants ----------------------------------------
# The 50 US state abbreviations in the order of R's built-in ``state.abb``.
STATE_ABB = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA",
    "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD",
    "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ",
    "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC",
    "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY",
)
