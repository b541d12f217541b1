"""Splits and models: closed-form OLS, planted signals, stable hash splits."""

import math

import pytest

from pyspark.sql import functions as F

from provguard.operators import models as M


def test_hash_split_disjoint_complete_stable(spark):
    df = spark.range(0, 20000).withColumnRenamed("id", "k")
    tr, te = M.hash_split(df, "k", 0.5, seed=1099)
    n_tr, n_te = tr.count(), te.count()
    assert n_tr + n_te == 20000 and 9000 < n_tr < 11000
    assert tr.join(te, "k").count() == 0
    tr2, _ = M.hash_split(df.repartition(13), "k", 0.5, seed=1099)
    assert tr2.count() == n_tr and tr2.exceptAll(tr).count() == 0


def test_ols_closed_form(spark):
    rows = [(float(x), 3.0 * x + 2.0 + (0.5 if x % 2 else -0.5)) for x in range(1, 101)]
    df = spark.createDataFrame(rows, "x double, y double")
    got = M.ols_one(df, "y", "x").first()
    xs = [r[0] for r in rows]
    ys = [r[1] for r in rows]
    mx, my = sum(xs) / len(xs), sum(ys) / len(ys)
    slope = sum((a - mx) * (b - my) for a, b in zip(xs, ys)) / sum((a - mx) ** 2 for a in xs)
    assert math.isclose(got.slope, round(slope, 4), abs_tol=1e-4)
    assert math.isclose(got.intercept, round(my - slope * mx, 4), abs_tol=1e-4)
    summ = {r.term: r for r in M.linear_summary(df, "y ~ x").collect()}
    assert set(summ) == {"x", "(Intercept)"} and summ["x"].p_value < 1e-6
    glm = {r.term: r.estimate for r in M.glm_summary(df, "y ~ x").collect()}
    assert math.isclose(glm["x"], slope, rel_tol=1e-6)


def test_hash_split_keeps_small_shares(spark):
    tr, te = M.hash_split(spark.range(50_000).withColumnRenamed("id", "k"), "k", 0.999, seed=1)
    assert 20 < te.count() < 90 and tr.count() + te.count() == 50_000


def test_class_weights_keep_null_labels(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (0.0,), (None,)], "label double")
    assert sorted((r.label, r.weight) for r in M.class_weights(df).where("label is not null").collect()) == [(0.0, 1.5), (1.0, 0.75), (1.0, 0.75)]
    assert M.class_weights(df).count() == 4


def test_logistic_without_convergence_is_an_error(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("rndrng_npi"), F.when(F.rand(1) > 0.5, "true").otherwise("false").alias("fraud"),
                                 F.rand(2).alias("x"), F.rand(3).alias("z"))
    with pytest.raises(RuntimeError):
        M.fit_logistic_predict(df, "fraud ~ .", max_iter=1)


def test_formula_and_logistic(spark):
    df = spark.range(400).select(
        F.col("id").cast("string").alias("rndrng_npi"),
        F.when(F.col("id") % 10 == 0, "true").otherwise("false").alias("fraud"),
        F.when(F.col("id") % 10 == 0, 5.0).otherwise(None).alias("code_a"),
        F.lit("Internal Medicine").alias("rndrng_prvdr_type"))
    ff = M.formula_features(df, "fraud ~ . - rndrng_prvdr_type", drop=["rndrng_npi"])
    assert ff.count() == 400 and ff.columns == ["label", "features"]
    pred = M.fit_logistic_predict(df, "fraud ~ . - rndrng_prvdr_type")
    acc = pred.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    assert acc > 0.95
