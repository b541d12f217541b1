"""Operators on small hand-made frames (with nulls) and property checks."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from provguard.functions import exprs as X
from provguard.operators import aggregates as A
from provguard.operators import filters as FL
from provguard.operators import joins as J
from provguard.operators import profile as P
from provguard.operators import reshape as R
from provguard.operators import windows as W


@pytest.fixture(scope="module")
def people(spark):
    rows = [("a", "CA", "x1", 10.0, dt.date(2001, 3, 1)),
            ("b", "CA", None, 20.0, dt.date(2001, 7, 1)),
            ("c", "NY", "x2", None, dt.date(2002, 3, 9)),
            ("d", None, "x3", 40.0, dt.date(2002, 3, 1)),
            ("e", "NY", None, 50.0, None),
            ("f", "TX", "x2", 60.0, dt.date(2003, 1, 1))]
    return spark.createDataFrame(rows, "id string, state string, code string, v double, d date")


def test_not_in_null_rules(people):
    keep = FL.filter_not_in(people, "state", ["CA"], keep_null=True)
    drop = FL.filter_not_in(people, "state", ["CA"], keep_null=False)
    assert sorted(r.id for r in keep.collect()) == ["c", "d", "e", "f"]
    assert sorted(r.id for r in drop.collect()) == ["c", "e", "f"]


def test_filters(people):
    assert FL.filter_eq(people, state="CA").count() == 2
    assert FL.filter_in(people, "state", ["CA", "TX"]).count() == 3
    assert FL.filter_null(people, "code").count() == 2
    assert FL.drop_null(people, ["code"]).count() == 4
    assert FL.drop_null(people).count() == 2
    assert FL.filter_date_range(people, "d", after="2001-06-01", before="2003-01-01").count() == 3
    assert FL.filter_contains(people, "code", "2").count() == 2
    txt = people.select(F.coalesce("code", F.lit("NA")).alias("code"))
    assert FL.filter_not_sentinel(txt, "code").count() == 4


def test_exprs(spark):
    df = spark.createDataFrame([("20200131", "1/2/2020", 4.0, 0, None, "u"),
                                ("2020XX01", "13/2/2020", 1.0, 2, "n", None)],
                               "a string, b string, x double, y long, npi string, upin string")
    out = df.select(X.parse_date("a").alias("a"), X.parse_date("b", "M/d/yyyy").alias("b"),
                    X.ratio("x", "y").alias("r"), X.presence_flag("npi", "upin").alias("f"),
                    X.null_if_token("a", ["20200131"]).alias("t")).collect()
    assert out[0]["a"] == dt.date(2020, 1, 31) and out[1]["a"] is None
    assert out[0]["b"] == dt.date(2020, 1, 2) and out[1]["b"] is None
    assert out[0]["r"] is None and out[1]["r"] == 0.5
    assert [r["f"] for r in out] == [1, 1]
    assert out[0]["t"] is None
    lab = df.select(X.code_to_label("y", {0: "zero", 2: "two"}).alias("l")).collect()
    assert [r["l"] for r in lab] == ["zero", "two"]


def test_label_join_keeps_rows_and_dedupes(spark):
    facts = spark.createDataFrame([("1",), ("2",), ("2",), ("3",), (None,)], "k string")
    listed = spark.createDataFrame([("2",), ("2",), ("3",), (None,)], "npi string")
    out = J.label_by_membership(facts, listed, "k", "npi", "fraud")
    rows = sorted((r.k or "", r.fraud) for r in out.collect())
    assert rows == [("", "no"), ("1", "no"), ("2", "yes"), ("2", "yes"), ("3", "yes")]
    fan = J.left_join_fanout(facts, listed.withColumn("excluded", F.lit(1)), "k", "npi",
                             ["excluded"])
    assert fan.count() == 7  # "2" twice on each side -> 4 rows


def test_null_and_hot_keys_spread(spark):
    """90 % null keys and a hot key: same rows as the plain join, no task with most of them."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        facts = spark.range(20_000).select("id", F.when(F.col("id") % 10 == 0, F.when(F.col("id") % 20 == 0, "hot").otherwise(F.col("id").cast("string"))).alias("k"))
        members = spark.createDataFrame([("hot",), ("30",), (None,), ("hot",)], "k string")
        out = J.label_by_membership(facts, members, "k")
        assert out.count() == 20_000
        assert {r.id for r in out.where("fraud = 'yes'").collect()} == {30, *range(0, 20_000, 20)}
        most = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert most < 6_000
        assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old[0])
        spark.conf.set("spark.sql.adaptive.enabled", old[1])


def test_sparse_features_any_number_of_codes(spark):
    df = spark.range(12_000).select((F.col("id") % 3).alias("p"), F.when(F.col("id") > 0, F.concat(F.lit("c"), "id")).alias("code"), F.col("id").cast("double").alias("x"))
    out = {r.p: r.features for r in R.sparse_agg(df, ["p"], "code", F.avg("x")).collect()}
    assert sum(map(len, out.values())) == 12_000 and out[0]["NA"] == 0.0 and out[2]["c5"] == 5.0


def test_enrich_keeps_unmatched(spark):
    counts = spark.createDataFrame([("a", 3), ("z", 1), (None, 2)], "statute string, n long")
    lookup = spark.createDataFrame([("a", "A")], "statute string, d string")
    got = {r.statute: r.d for r in J.enrich(counts, lookup, "statute").collect()}
    assert got == {"a": "A", "z": None, None: None}


def test_aggregates(people):
    c = {r.state: r.n for r in A.count_by(people, ["state"]).collect()}
    assert c == {"CA": 2, "NY": 2, "TX": 1, None: 1}
    y = {(r.year, r.n) for r in A.count_by_year(people, "d").collect()}
    assert (dt.date(2002, 1, 1), 2) in y and (None, 1) in y
    rates = A.presence_rates(people, ["state"], ["code"]).where("state = 'CA'").first()
    assert rates.n_code == 1 and rates.n_obs == 2 and rates.pct_code == 50.0
    shares = A.share_of_total(A.count_by(people, ["state"]), "n", "p").collect()
    assert math.isclose(sum(r.p for r in shares), 1.0, abs_tol=1e-9)
    d = {r.state: r.n_distinct for r in A.count_distinct_by(people, ["state"], "code").collect()}
    assert d["NY"] == 1 and d["CA"] == 1
    m = A.mean_all(people).first()
    assert m.v == 36.0
    fb = A.freq_table(people, "code").collect()
    assert sorted((r.code, r.n) for r in fb) == [("x1", 1), ("x2", 2), ("x3", 1)]
    cb = A.class_balance(people, "state", "CA").first()
    assert cb.n_positive == 2 and cb.n_rows == 6
    h = {r.bin_start: r.n for r in A.histogram(people, "v", 20).collect()}
    assert h == {10.0: 2, 30.0: 1, 50.0: 2}
    assert A.row_count(people).first().n == 6


def test_monthly_average(people):
    out = {r.month: r for r in A.monthly_average(people, "d").collect()}
    assert out[3].month_label == "Mar" and math.isclose(out[3]["count"], 3 / 3)
    assert math.isclose(out[3].avg_count, (1 + 1 + 3) / 3 / 3)
    fixed = {r.month: r["count"] for r in A.monthly_average(people, "d", years=46).collect()}
    assert math.isclose(fixed[3], 3 / 46)


def test_lump_top_n_ties_and_null(spark):
    vals = ["a"] * 5 + ["b"] * 4 + ["c"] * 4 + ["d"] * 2 + ["e"] * 1 + [None] * 3
    df = spark.createDataFrame([(v,) for v in vals], "x string")
    out = W.lump_top_n(df, "x", 2)
    got = {r.x: r.n for r in out.groupBy("x").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"a": 5, "b": 4, "c": 4, "Other": 3, None: 3}  # tie at rank 2 kept
    assert out.count() == df.count()
    single = W.lump_top_n(df, "x", 4)  # only "e" would be lumped: nothing lumped
    assert "Other" not in {r.x for r in single.collect()}


def test_ordering(spark):
    g = spark.createDataFrame([("a", 5), ("b", 9), ("c", 5)], "k string, n long")
    lo = {r.k: r.n_ord for r in W.level_order(g, "n", "n_ord").collect()}
    assert lo == {"a": 1, "c": 1, "b": 2}
    od = {r.k: r.order for r in W.ordinal(g, [F.col("n").desc(), F.col("k")]).collect()}
    assert od == {"b": 1, "a": 2, "c": 3}


def test_row_ids_match_global_order(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k"))
    out = W.row_ids(df.repartition(7), ["k"], "rid", partitions=5).collect()
    pairs = sorted((r.k, r.rid) for r in out)
    assert [p[1] for p in pairs] == list(range(1, 5001))


def test_zscore(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0), ("c", "x", 3.0),
                                ("a", "y", 5.0), ("b", "y", 5.0)], "r string, c string, v double")
    out = W.zscore_by(df, ["c"], "v").collect()
    zx = [r.z for r in out if r.c == "x"]
    assert math.isclose(sum(zx), 0.0, abs_tol=1e-12)
    assert math.isclose(sum(z * z for z in zx) / 2, 1.0)
    assert all(r.z is None for r in out if r.c == "y")


def test_pivot_unpivot_roundtrip(people):
    wide = R.pivot_count(people, ["state"], "code", ["x1", "x2", "x3"], fill=0,
                         null_label=None)
    long = R.unpivot(wide, ["state"], ["x1", "x2", "x3"], "code", "n")
    total = long.agg(F.sum("n")).first()[0]
    assert total == people.where("code is not null").count()
    wna = R.pivot_count(people, ["state"], "code", ["x1", "x2", "x3", "NA"], fill=0,
                        null_label="NA")
    assert wna.agg(F.sum("NA")).first()[0] == 2
    comp = R.pivot_agg(people, ["state"], R.composite_key("code", "id"), F.sum("v"))
    assert "x1_a" in comp.columns


def test_unpivot_prefix_and_match(spark):
    df = spark.createDataFrame([(2001, 1.0, 2.0, 9)], "year int, pct_npi double, pct_upin double, n int")
    long = R.unpivot(df, ["year"], R.column_range(df, "pct_npi", "pct_upin"), "identifier",
                     "percent", names_prefix="pct_")
    assert sorted(r.identifier for r in long.collect()) == ["npi", "upin"]
    m = R.unpivot_matching(df.withColumnRenamed("pct_npi", "MeanA"), "Mean")
    assert m.columns == ["year", "pct_upin", "n", "name", "value"]
    assert R.select_ordered(df, ["n", "year"]).columns == ["n", "year"]
    with pytest.raises(KeyError):
        R.select_ordered(df, ["nope"])
    ins = R.insert_before(df, "id", F.lit(1), "pct_upin")
    assert ins.columns == ["year", "pct_npi", "id", "pct_upin", "n"]


def test_profile_and_describe(people):
    prof = {r.skim_variable: r for r in P.profile_columns(people).collect()}
    assert prof["code"].n_missing == 2 and prof["code"].character_n_unique == 3
    assert math.isclose(prof["code"].complete_rate, 4 / 6)
    assert prof["v"].skim_type == "numeric" and prof["v"].numeric_mean == 36.0
    assert prof["d"].skim_type == "Date" and prof["d"].date_n_unique == 5
    desc = {r.column: r for r in P.describe_numeric(people).collect()}
    assert desc["v"]["count"] == 5 and desc["v"]["min"] == 10.0 and desc["v"]["max"] == 60.0


def test_percentiles_and_boxplot(spark):
    df = spark.createDataFrame([("g", float(v)) for v in [1, 2, 3, 4, 5, 6, 7, 8, 100]],
                               "k string, v double")
    p = {r.p: r.value for r in P.percentiles(df, "v", [0.25, 0.5, 0.75]).collect()}
    assert p == {0.25: 3.0, 0.5: 5.0, 0.75: 7.0}
    med = P.median_by(df, ["k"], "v").first()["median"]
    assert med == 5.0
    bx = P.boxplot_stats(df, ["k"], "v").first()
    assert (bx.q1, bx.q3, bx.whisker_low, bx.whisker_high, bx.n_outliers) == (3.0, 7.0, 1.0, 8.0, 1)
    bx0 = P.boxplot_stats(df, [], "v").first()
    assert bx0.n_outliers == 1


def test_exact_percentiles_over_many_parts(spark):
    """Groups of different sizes, a hot group over several range parts, nulls, any probability."""
    import numpy as np
    rng = np.random.default_rng(2)
    rows = [(g, float(v)) for g, n in (("hot", 4000), ("b", 37), (None, 5), ("one", 1)) for v in np.round(rng.normal(size=n), 2 if g == "b" else 6)]
    df = spark.createDataFrame([*rows, ("hot", None), ("empty", None)], "g string, v double").repartition(5)
    probs = [0.0, 0.1, 0.5, 0.95, 1.0]
    got = {(r.g, r.p): r.value for r in P.percentiles(df, "v", probs, ["g"]).collect()}
    for g in ("hot", "b", None, "one"):
        want = np.quantile([v for k, v in rows if k == g], probs)
        assert all(math.isclose(got[g, p], w, abs_tol=1e-9) for p, w in zip(probs, want))
    med = {r.g: r.m for r in P.median_by(df, ["g"], "v", "m").collect()}
    assert med["empty"] is None and math.isclose(med["hot"], got["hot", 0.5])


def test_factor_profile_and_report(people):
    prof = P.profile_columns(people, factors=["state"])
    row = {r.skim_variable: r for r in prof.collect()}["state"]
    assert row.skim_type == "factor" and row.character_n_unique is None and row.n_missing == 1
    rates = [r.complete_rate for r in P.completion_table(prof).collect()]
    assert rates == sorted(rates, reverse=True) and all(round(r, 3) == r for r in rates)


def test_corr_long(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, None), (3.0, 6.5, 1.0),
                                (4.0, 8.0, 0.0)], "a double, b double, c double")
    out = {(r.x, r.y): r.r for r in P.corr_long(df, ["a", "b", "c"]).collect()}
    assert set(out) == {("b", "a"), ("c", "a"), ("c", "b")}
    assert out[("b", "a")] > 0.99
    full = P.corr_long(df, ["a", "b"], lower_only=False).count()
    assert full == 4


def test_corr_mllib_matches_aggregate(spark):
    df = spark.range(200).select((F.col("id") * 1.0).alias("a"),
                                 (F.col("id") % 7 * 1.0).alias("b"),
                                 (F.col("id") * F.col("id") * 1.0).alias("c"))
    agg = {(r.x, r.y): r.r for r in P.corr_long(df, ["a", "b", "c"]).collect()}
    ml = {(r.x, r.y): r.r for r in P.corr_matrix_mllib(df, ["a", "b", "c"]).collect()}
    assert len(ml) == 9 and math.isclose(ml[("a", "a")], 1.0)
    for k, v in agg.items():
        assert math.isclose(v, ml[k], rel_tol=1e-9, abs_tol=1e-12)


def test_count_distinct_null_rule(people):
    sql = {r.state: r.n_distinct for r in A.count_distinct_by(people, ["state"], "code").collect()}
    r = {r.state: r.n_distinct
         for r in A.count_distinct_by(people, ["state"], "code", include_null=True).collect()}
    assert sql["NY"] == 1 and r["NY"] == 2  # x2 and NA
    assert sql["TX"] == 1 and r["TX"] == 1
