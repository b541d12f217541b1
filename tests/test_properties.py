"""Property tests: R's null rules against a plain-Python statement of them."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provguard.functions import exprs as X

WORDS = st.sampled_from(["a", "b", "ab", "ba", "c", None])


@settings(max_examples=15, deadline=None)
@given(values=st.lists(WORDS, min_size=1, max_size=12), banned=st.lists(WORDS, max_size=3))
def test_membership_rules(spark, values, banned):
    banned = [b for b in banned if b is not None]
    df = spark.createDataFrame([(v,) for v in values], "x string")
    out = df.select(
        X.not_in_keep_null("x", banned).alias("keep"),
        X.not_in_drop_null("x", banned).alias("drop"),
        X.contains_or_false("x", "a").alias("has_a")).collect()
    for v, r in zip(values, out):
        assert r["keep"] == (v is None or v not in banned)       # !(x %in% v)
        assert r["drop"] == (v is not None and v not in banned)  # SQL NOT IN / NA in list
        assert r["has_a"] == (v is not None and "a" in v)        # grepl("a", x)


@settings(max_examples=10, deadline=None)
@given(days=st.lists(st.integers(min_value=-20000, max_value=20000), min_size=1, max_size=10),
       junk=st.sampled_from(["", "2020", "20201340", "abcdefgh", "00000000"]))
def test_compact_date_parse(spark, days, junk):
    base = dt.date(1970, 1, 1)
    dates = [base + dt.timedelta(days=d) for d in days]
    texts = [d.strftime("%Y%m%d") for d in dates] + [junk]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["d"] for r in df.select(X.parse_date("t").alias("d")).collect()]
    assert got[:-1] == dates
    assert got[-1] is None


@settings(max_examples=10, deadline=None)
@given(rows=st.lists(st.tuples(st.one_of(st.none(), st.sampled_from(["1", "2"])),
                               st.one_of(st.none(), st.sampled_from(["u"]))),
                     min_size=1, max_size=10))
def test_presence_flag(spark, rows):
    df = spark.createDataFrame(rows, "npi string, upin string")
    got = [r["f"] for r in df.select(X.presence_flag("npi", "upin").alias("f")).collect()]
    assert got == [0 if (a is None and b is None) else 1 for a, b in rows]


def test_year_floor_and_age(spark):
    df = spark.createDataFrame([(dt.date(2020, 12, 31), dt.date(1960, 1, 1))], "d date, b date")
    r = df.select(X.year_floor("d").alias("y"), X.years_between("d", "b").alias("age"),
                  X.month_abbr("d").alias("m"), F.lit(1).alias("one")).first()
    assert (r.y, r.age, r.m) == (dt.date(2020, 1, 1), 60, "Dec")
