"""Coefficient tables, sparse vectors, blocked moments, filters, stores, sketches and grids."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from provguard.operators import joins as J
from provguard.operators import models as M
from provguard.operators import profile as P
from provguard.operators import reshape as R
from provguard.operators import sketches as SK
from provguard.operators import sparse as SP
from provguard.operators import windows as W
from provguard.plans import catalog
from provguard.plans import pipelines as PL
from provguard.plans import standins as S
from provguard.session import compiled_projections, scratch_path
from provguard.sources import store

from .conftest import SF_SMALL


# --- logistic table -----------------------------------------------------------

def plain_newton(x, y, steps=30):
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        f = 1 / (1 + np.exp(-x @ b))
        info = (x * (f * (1 - f))[:, None]).T @ x
        b = b + np.linalg.solve(info, x.T @ (y - f))
    return b, np.sqrt(np.diag(np.linalg.inv(info)))


@pytest.mark.parametrize("parts", [1, 7])
def test_logistic_terms(spark, parts):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 3))
    y = (rng.random(800) < 1 / (1 + np.exp(-(x @ [1.0, -0.5, 0.0] + 0.7)))).astype(float)
    df = spark.createDataFrame([(("yes" if b else "no"), *map(float, a)) for a, b in zip(x, y)], "y string, a double, b double, c double")
    got = {r.term: r for r in M.logistic_terms(df.repartition(parts), "y ~ .").collect()}
    beta, se = plain_newton(x, y)
    for t, b, e in zip(("a", "b", "c", "(Intercept)"), beta, se):
        assert math.isclose(got[t].estimate, b, rel_tol=1e-8, abs_tol=1e-9) and math.isclose(got[t].std_err, e, rel_tol=1e-8)
        assert math.isclose(got[t].z_value, b / e, rel_tol=1e-7) and math.isclose(got[t].p_value, math.erfc(abs(b / e) / 2 ** 0.5), rel_tol=1e-6)
    assert got["a"].p_value < 1e-6 < 0.01 < got["c"].p_value


def test_logistic_terms_dependent_columns_and_one_class(spark):
    """A column that repeats another has no error of its own; the rest keep theirs."""
    rng = np.random.default_rng(4)
    rows = [("t" if rng.random() < 0.4 + 0.2 * (k % 2) else "f", float(k % 2), 2.0 * (k % 2), float(rng.normal())) for k in range(400)]
    df = spark.createDataFrame(rows, "y string, a double, twice double, c double")
    got = {r.term: r for r in M.logistic_terms(df, "y ~ .").collect()}
    assert got["a"].std_err is None and got["twice"].std_err is None and got["c"].std_err > 0 and got["(Intercept)"].std_err > 0
    one = M.logistic_terms(df.withColumn("y", F.lit("t")), "y ~ a + c").collect()
    assert {r.term for r in one} == {"a", "c", "(Intercept)"} and all(r.estimate is None for r in one)


# --- sparse vectors -------------------------------------------------------------

def test_sparse_fit_equals_wide_fit(spark):
    """The label model on the pivot and on the vector column: the same predictions."""
    rng = np.random.default_rng(5)
    rows = [(f"p{k}", "G" if k % 3 else "H", f"c{c}", float(rng.integers(1, 9))) for k in range(300) for c in rng.choice(6, 3, replace=False)]
    long = spark.createDataFrame(rows, "rndrng_npi string, kind string, code string, value double")
    keys = ["rndrng_npi", "kind"]
    fraud = F.when(F.pmod(F.xxhash64("rndrng_npi"), F.lit(5)) < 2, "true").otherwise("false")
    wide = R.pivot_agg(long, keys, "code", F.avg("value")).withColumn("fraud", fraud)
    index = SP.code_index(long, "code")
    assert [tuple(r) for r in index.orderBy("index").collect()] == [(f"c{k}", k) for k in range(6)]
    sparse = SP.sparse_vectors(long, keys, "code", "value", index, 6).withColumn("fraud", fraud)
    a = {r.rndrng_npi: r.p_positive for r in M.fit_logistic_predict(wide, "fraud ~ .", tol=1e-10).collect()}
    b = {r.rndrng_npi: r.p_positive for r in M.fit_logistic_predict(sparse, "fraud ~ kind", tol=1e-10, vectors=["codes"]).collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-5


def test_ten_thousand_codes_fit(spark):
    long = spark.range(40_000).select((F.col("id") % 2000).cast("string").alias("rndrng_npi"),
                                      F.concat(F.lit("code"), F.pmod(F.xxhash64("id"), F.lit(10_000))).alias("code"), F.lit(1.0).alias("value"))
    long = long.distinct()
    index = SP.code_index(long, "code")
    n = index.count()
    assert n > 9500
    df = SP.sparse_vectors(long, ["rndrng_npi"], "code", "value", index, n).withColumn(
        "fraud", F.when(F.pmod(F.xxhash64("rndrng_npi"), F.lit(4)) == 0, "true").otherwise("false")).withColumn("one", F.lit(1.0))
    out = M.fit_logistic_predict(df, "fraud ~ one", vectors=["codes"], tol=1e-3, max_iter=60)
    assert out.count() == 2000
    assert out.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0] > 0.95


def test_sparse_vector_odd_rows(spark):
    """Unknown and null codes are left out; a key without codes keeps an empty vector."""
    long = spark.createDataFrame([("a", "x", 1.5), ("a", "z", 2.0), ("b", "new", 1.0), ("c", None, 1.0), ("d", "y", None), ("e", "y", 0.0)], "k string, code string, v double")
    index = spark.createDataFrame([("x", 0), ("y", 1), ("z", 2)], "code string, index int")
    out = {r.k: r.codes for r in SP.sparse_vectors(long, ["k"], "code", "v", index, 3).collect()}
    assert out["a"].toArray().tolist() == [1.5, 0.0, 2.0] and all(out[k].toArray().tolist() == [0.0] * 3 for k in "bcde")
    entries = {r.k: r.e for r in SP.sparse_vectors(long, ["k"], "code", "v", index, 3).select("k", SP.vector_entries("codes").alias("e")).collect()}
    assert [(e["index"], e["value"]) for e in entries["a"]] == [(0, 1.5), (2, 2.0)]


# --- blocked moments --------------------------------------------------------------

@pytest.mark.parametrize("p, block", [(500, 500), (40, 13), (3, 500)])
def test_corr_blocks(spark, p, block):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, p)) + 1e6
    x[:, 1] = 2 * x[:, 0] + rng.normal(size=300)
    x[:, 2] = 7.0
    x[rng.random(x.shape) < 0.2] = np.nan
    cols = [f"c.{k}" for k in range(p)]
    df = spark.createDataFrame([tuple(None if math.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"`{c}` double" for c in cols)).repartition(4)
    got = {(r.x, r.y): r.r for r in P.corr_blocks(df, cols, block=block).collect()}
    assert len(got) == p * (p - 1) // 2
    for a, b in ((1, 0), (2, 0), (2, 1), *((int(i), int(j)) for i, j in rng.integers(0, p, (200, 2)) if i > j)):
        ok = ~np.isnan(x[:, a]) & ~np.isnan(x[:, b])
        r = got[cols[a], cols[b]]
        if 2 in (a, b):
            assert r is None
        else:
            assert math.isclose(r, np.corrcoef(x[ok, a], x[ok, b])[0, 1], abs_tol=1e-9)
    assert p > 3 or len(P.corr_blocks(df, cols, lower_only=False).collect()) == p * p


def test_corr_blocks_reads_rows_once_as_compiled_code(spark):
    """One pass over the rows, under the limit of methods that the JVM compiles, which is put back."""
    key, rows, limits = "spark.sql.codegen.hugeMethodLimit", spark.sparkContext.accumulator(0), []
    before = spark.conf.get(key)

    def counted(batches):
        for b in batches:
            rows.add(b.num_rows)
            yield b

    df = spark.range(4000, numPartitions=4).select(*[F.when(F.col("id") % (k + 3) != 0, F.col("id") * k % 17 + 1e7).alias(f"c{k}") for k in range(20)],
                                                   F.lit(0.1).alias("same"), F.lit(None).cast("double").alias("none"))
    out = P.corr_blocks(df.mapInArrow(counted, df.schema), df.columns)
    got = {(r.x, r.y): r.r for r in out.collect()}
    assert rows.value == 4000 and spark.conf.get(key) == before
    with pytest.raises(ValueError), compiled_projections(spark):
        limits.append(spark.conf.get(key))
        raise ValueError
    assert limits == ["8000"] and spark.conf.get(key) == before
    assert len(got) == 22 * 21 // 2 and all(v is None for (x, y), v in got.items() if {x, y} & {"same", "none", "c0"})
    want = df.select(F.corr("c7", "c3")).first()[0]
    assert abs(got["c7", "c3"] - want) < 1e-9


def test_corr_blocks_of_sorted_rows(spark):
    """Tasks with centres far apart, and a column that some tasks never see."""
    df = spark.range(9000, numPartitions=6).select((F.col("id") * 1e3).alias("a"), (F.col("id") ** 2 / 7).alias("b"), F.when(F.col("id") > 4000, -F.col("id") + F.col("id") % 5).alias("c"))
    got = {(r.x, r.y): r.r for r in P.corr_blocks(df, df.columns, block=2).collect()}
    for x, y in got:
        assert abs(got[x, y] - df.where(f"{x} is not null and {y} is not null").select(F.corr(x, y)).first()[0]) < 1e-9


def test_corr_blocks_agrees_with_corr(spark):
    df = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    a, b = ({(r.x, r.y): r.r for r in f(df, cols).collect()} for f in (P.corr_long, P.corr_blocks))
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], abs_tol=1e-9) for k in a)


# --- Bloom label join ---------------------------------------------------------------

def no_broadcast(spark):
    conf = {"spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    return lambda: [spark.conf.unset(k) if v is None else spark.conf.set(k, v) for k, v in old.items()]


def test_bloom_label(spark):
    """The label of the plain join; the filter lets the list's rows through and few others."""
    facts = spark.range(200_000).select(F.when(F.col("id") % 1000 == 1, None).otherwise(F.col("id").cast("string")).alias("npi"), F.lit(1).alias("v"))
    listed = spark.range(0, 200_000, 97).select(F.col("id").cast("string").alias("npi")).union(spark.createDataFrame([(None,), ("0",)], "npi string"))
    back = no_broadcast(spark)
    try:
        out = J.label_by_bloom(facts, listed, "npi")
        got = {(r.fraud, r.npi): r["count"] for r in out.where("fraud = 'yes' or npi is null").groupBy("fraud", "npi").count().collect()}
        assert out.count() == 200_000
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        back()
    want = {("yes", str(k)): 1 for k in range(0, 200_000, 97) if k % 1000 != 1}
    assert got == want | {("no", None): 200}
    assert plan.count("scalar-subquery") >= 2  # one filter before the join, its opposite on the branch without one
    words = 2062 * J.BLOOM_BITS_PER_KEY // 64
    keys = listed.where("npi is not null").distinct()
    bloom = J.bloom_words(keys, "npi", words)
    passed = facts.where(J.might_hold(bloom, F.col("npi"), words)).count()
    hits = len(want)
    assert hits <= passed <= hits + 0.01 * 200_000


def test_bloom_merge_and_long_list(spark):
    a, b = (spark.range(lo, lo + 500).select(F.col("id").cast("string").alias("k")) for lo in (0, 300))
    merged = J.merge_bloom(J.bloom_words(a, "k", 64), J.bloom_words(b, "k", 64))
    whole = J.bloom_words(a.union(b), "k", 64)
    assert sorted(merged.collect()) == sorted(whole.collect())
    facts = spark.range(2000).select(F.col("id").alias("npi"))
    lab = J.label_by_bloom(facts, a, "npi", "k", max_bytes=8)  # too long for the filter
    assert lab.where("fraud = 'yes'").count() == 500
    assert J.label_by_bloom(facts, a.where("false"), "npi", "k").where("fraud = 'yes'").count() == 0
    assert J.label_by_bloom(facts, a, "npi", "k").where("fraud = 'yes'").count() == 500  # key types differ


# --- claim store --------------------------------------------------------------------

def test_claim_store_joins_without_exchange(spark):
    claims = S.claims(spark, SF_SMALL)
    path = scratch_path(spark, "store")
    name = store.table_name("claims")
    kept = store.write_claim_store(claims.where("year < 2000"), name, path, buckets=4)
    kept = store.append_year(spark, claims.where("year >= 2000"), name, path, buckets=4)
    assert kept.count() == claims.count()
    members = spark.createDataFrame([("1",), ("7",), ("7",), (None,)], "rndrng_npi string")
    listed = store.write_member_store(members, store.table_name("listed"), scratch_path(spark, "listed"), "rndrng_npi", buckets=4)
    back = no_broadcast(spark)
    try:
        out = store.label_from_store(kept.where("year = 1998"), listed)
        rows = out.groupBy("fraud").count().collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        back()
    want = claims.where("year = 1998").groupBy(F.when(F.col("rndrng_npi").isin("1", "7"), "yes").otherwise("no").alias("fraud")).count()
    assert sorted(rows) == sorted(want.collect())
    assert "Exchange" not in plan and "SortMergeJoin" in plan and "PartitionFilters: [isnotnull(year" in plan


def test_claim_store_buckets_grow_with_the_claims(spark, monkeypatch):
    """Both stores get as many buckets as the tables need, and the labels stay."""
    few = sorted(map(tuple, catalog.QUERIES["claim_store"](spark, SF_SMALL).collect()))
    seen, write = [], store.write_bucketed
    monkeypatch.setattr(store, "BUCKET_BYTES", 1 << 12)
    monkeypatch.setattr(store, "write_bucketed", lambda df, table, path, key, buckets, *a, **k: seen.append(buckets) or write(df, table, path, key, buckets, *a, **k))
    assert sorted(map(tuple, catalog.QUERIES["claim_store"](spark, SF_SMALL).collect())) == few
    assert len(seen) == 2 and seen[0] == seen[1] > 8


# --- sketches -----------------------------------------------------------------------

def test_distinct_sketches_merge(spark):
    df = spark.range(300_000).select((F.col("id") % 12).alias("month"), F.when(F.col("id") % 5 == 0, "x").otherwise("y").alias("g"),
                                     F.when(F.col("id") % 100 != 0, F.pmod(F.xxhash64("id"), F.lit(50_000))).alias("big"), (F.col("id") % 40).alias("small"))
    loads = SK.distinct_sketches(df, ["month", "g"], ["big", "small"])
    assert loads.count() == 12 * 2 * 2
    exact = df.groupBy("g").agg(F.countDistinct("big").alias("big"), F.countDistinct("small").alias("small"),
                                F.count_if(F.col("big").isNull()).alias("missing"), F.count(F.lit(1)).alias("n")).collect()
    got = {(r.g, r.column): r for r in SK.merged_distinct(loads, ["g"]).collect()}
    for r in exact:
        assert abs(got[r.g, "big"].n_unique / r.big - 1) < 4 * 1.04 / 2 ** (SK.LG_K / 2)
        assert got[r.g, "small"].n_unique == r.small and got[r.g, "big"].n_missing == r.missing and got[r.g, "big"].n_rows == r.n
    with_null = {r.g: r.n_unique for r in SK.merged_distinct(loads.where("column = 'big'"), ["g"], count_null=True).collect()}
    assert all(with_null[r.g] == got[r.g, "big"].n_unique + (r.missing > 0) for r in exact)


def test_quantile_sketches_merge(spark):
    df = spark.range(200_000).select((F.col("id") % 24).alias("month"), (F.col("id") % 3).alias("g"),
                                     F.when(F.col("id") % 50 != 0, F.exp(F.pmod(F.xxhash64("id"), F.lit(100_000)) / 10_000)).alias("v"))
    df = df.union(spark.createDataFrame([(1, 9, 5.0), (2, 9, 7.0), (3, 9, None)], "month long, g long, v double"))
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    merged = SK.merged_quantiles(SK.quantile_sketches(df, ["month", "g"], "v"), ["g"], probs)
    errors = {(r.g, r.p): r.error for r in SK.rank_errors(df, ["g"], "v", merged).collect()}
    assert len(errors) == 4 * 5 and max(e for (g, _), e in errors.items() if g != 9) <= 0.012
    small = {r.p: r.value for r in merged.where("g = 9").collect()}
    assert small[0.0] == 5.0 and small[1.0] == 7.0 and {r.n for r in merged.where("g = 9").collect()} == {2}


# --- zero-filled grid ---------------------------------------------------------------

def test_count_grid(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", None), (None, "y"), ("c", "x")], "r string, c string")
    got = {(r.r, r.c): r.value for r in R.count_grid(df, "r", "c").collect()}
    assert got == {(r, c): 0 for r in ("a", "b", "c", None) for c in ("x", "y", "NA")} | {("a", "x"): 2, ("b", "NA"): 1, (None, "y"): 1, ("c", "x"): 1}
    assert R.count_grid(df.where("false"), "r", "c").collect() == []


def test_grid_plan_does_not_grow_with_levels(spark):
    """No job runs to build it, and its plan is the same for 3 levels and 3,000."""
    plans = []
    for n in (3, 3000):
        df = spark.range(6000).select((F.col("id") % 5).cast("string").alias("general"), (F.col("id") % n).cast("string").alias("excltype"))
        out = PL.matrix_zscores(df, "general", "excltype")
        plans.append(len(out._jdf.queryExecution().analyzed().toString()))
        assert out.count() == 5 * n
    assert abs(plans[0] - plans[1]) < 60
    z = W.zscore_by(R.count_grid(df, "general", "excltype"), ["excltype"], "value", "z").groupBy("excltype").agg(F.sum("z").alias("s")).agg(F.max(F.abs("s"))).first()[0]
    assert z is None or z < 1e-9
