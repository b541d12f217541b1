"""Every registered query runs; SQL-checked ones equal DuckDB on the same tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from provguard.sources.tables import DRIVER_TABLES

from .conftest import SF_SMALL

SQL_KEYS = sorted(entry.oracle_sql())
ROW_KEYS = sorted(set(entry.queries()) - set(SQL_KEYS))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return ""
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        f = float(v)
        return "nan" if math.isnan(f) else f"{round(f, 6):.6f}"
    if type(v).__name__ == "date":
        return v.isoformat()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, int) and not isinstance(v, bool):
        return f"{float(v):.6f}"
    return str(v)


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in recs)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["statute", "agency", "exclusion", "description", "n_count"]
    counts = [r.n_count for r in rows]
    assert counts == sorted(counts, reverse=True)


def test_every_sql_key_has_a_query():
    assert set(SQL_KEYS) <= set(entry.queries())
    assert len(entry.queries()) >= 70


@pytest.mark.parametrize("key", SQL_KEYS)
def test_matches_duckdb(spark, duck, key):
    df = entry.queries()[key](spark, SF_SMALL)
    srows = df.collect()
    res = duck.execute(entry.oracle_sql()[key])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, srows) == _rows(dcols, res.fetchall())


def test_rows_only_keys_are_the_models(spark):
    """Keys without SQL: forests, the logistic predictions, and those of the llm tests."""
    assert {k for k in ROW_KEYS if k != "pipeline" and not k.startswith("op")} == {
        "forest_importance", "permutation_importance", "logit_label"}


def test_logit_label_rows(spark):
    got = entry.queries()["logit_label"](spark, SF_SMALL).collect()
    npis = {r.rndrng_npi for r in entry.queries()["provider_features"](spark, SF_SMALL).collect()}
    assert {r.rndrng_npi for r in got} == npis
    assert all(0 <= r.p_positive <= 1 and r.prediction == (r.p_positive > 0.5) for r in got)


def test_forest_rows(spark):
    wide = entry.queries()["permutation_importance"](spark, SF_SMALL).collect()
    assert {r.vars for r in wide} == {"specialty", "dob", "city", "state", "zip", "excltype", "excldate", "age_at_excl"}
    assert all(r.MeanDecreaseGini >= 0 and 0.5 < r.oob_accuracy < 1 for r in wide)
    long = entry.queries()["forest_importance"](spark, SF_SMALL).collect()
    order = [r.vars for r in sorted(wide, key=lambda r: r.MeanDecreaseAccuracy)]
    for name in ("MeanDecreaseAccuracy", "MeanDecreaseGini"):  # one order for both measures
        assert [r.vars for r in sorted((r for r in long if r.name == name), key=lambda r: r.vars_ord)] == order
