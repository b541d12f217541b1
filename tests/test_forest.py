"""The bagged forest: brute-force trees, planted signals, id-like factors, partitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from provguard.operators import forest as FO


def brute_tree(x, y, w, classes, tree, seed, mtry, max_depth):
    """A node at a time in plain Python: nodes as (rows, split or None, class), and falls of impurity."""
    p = len(x[0])
    fall, nodes, level = [0.0] * p, [], [[i for i in range(len(y)) if w[i]]]
    for depth in range(max_depth + 1):
        base, below = len(nodes), []
        for k, rows in enumerate(level):
            ident = base + k
            total = [sum(w[i] for i in rows if y[i] == c) for c in range(classes)]
            tie = FO.draws(seed, np.array([ident]), tree, 1) + np.arange(classes, dtype=np.uint64)
            klass = max(range(classes), key=lambda c: (total[c], int(FO.mixed(tie)[c])))
            order = FO.draws(seed, ident * p + np.arange(p), tree, 2)
            n, best = sum(total), (0.0, None)
            whole = sum(t * t for t in total) / n
            for j in sorted(range(p), key=lambda j: int(order[j]))[:mtry] if depth < max_depth else ():
                gains = []
                for cut in sorted({x[i][j] for i in rows})[:-1]:
                    left = [sum(w[i] for i in rows if y[i] == c and x[i][j] <= cut) for c in range(classes)]
                    right = [t - s for t, s in zip(total, left)]
                    gains.append((sum(t * t for t in left) / sum(left) + sum(t * t for t in right) / sum(right) - whole, -cut))
                if gains and max(gains)[0] > best[0] + 1e-9 * n:
                    best = (max(gains)[0], (j, -max(gains)[1]))
            split = best[1]
            if split:
                fall[split[0]] += best[0]
                below += [[i for i in rows if x[i][split[0]] <= split[1]], [i for i in rows if x[i][split[0]] > split[1]]]
            nodes.append((rows, split, klass, base + len(level) + len(below) - 2))
        level = below
        if not level:
            break
    return nodes, fall


def brute_predict(nodes, row):
    at = 0
    while nodes[at][1]:
        j, cut = nodes[at][1]
        at = nodes[at][3] + (row[j] > cut)
    return nodes[at][2]


@pytest.mark.parametrize("seed, classes, max_depth", [(1, 2, 30), (2, 3, 30), (3, 2, 3), (4, 2, 1)])
def test_tree_against_brute_force(seed, classes, max_depth):
    rng = np.random.default_rng(seed)
    n, p = 120, 4
    x = rng.integers(0, 9, (n, p)).astype(np.uint8)
    y = np.where(rng.random(n) < 0.8, (x[:, 1] > 4) + (x[:, 2] > 6) * (classes > 2), rng.integers(0, classes, n)).astype(int)
    keys = rng.integers(-2**62, 2**62, n)
    for tree in range(5):
        w = FO.bag_counts(seed, keys, tree, 1.0)
        order = sorted(range(n), key=lambda i: int(keys[i]))
        nodes, fall = brute_tree(x.tolist(), y.tolist(), w.tolist(), classes, tree, seed, 2, max_depth)
        got_fall, n_out, right, permuted = FO.tree_importances(tree, keys, x, y, w, classes, seed, 2, max_depth)
        assert np.allclose(got_fall, fall) and n_out == int((w == 0).sum())
        out = [i for i in order if not w[i]]
        assert right == sum(brute_predict(nodes, x[i].tolist()) == y[i] for i in out)
        for j in range(p):
            moved = sorted(range(len(out)), key=lambda k: int(FO.draws(seed, keys[[out[k]]], tree, 3, j)[0]))
            hits = 0
            for k, i in enumerate(out):
                row = x[i].tolist()
                row[j] = int(x[out[moved[k]]][j])
                hits += brute_predict(nodes, row) == y[i]
            assert permuted[j] == hits


def test_bag_counts_are_poisson():
    keys = np.arange(200_000)
    for rate in (1.0, 0.3):
        w = FO.bag_counts(5, keys, 3, rate)
        for k in range(4):
            assert abs((w == k).mean() - math.exp(-rate) * rate ** k / math.factorial(k)) < 0.005
    assert not (FO.bag_counts(5, keys, 3, 1.0) == FO.bag_counts(5, keys, 4, 1.0)).all()


def planted(spark, n=1500):
    """A label that follows ``signal`` in 9 rows of 10; ``noise``, and ``ident``, a text of its own in every row."""
    h = F.pmod(F.xxhash64("id"), F.lit(1000))
    return spark.range(n).select(
        F.col("id").alias("k"), F.when(F.when(h < 900, F.col("id") % 2).otherwise(1 - F.col("id") % 2) == 0, "present").otherwise("missing").alias("y"),
        ((F.col("id") % 2) * 50 + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(40))).cast("double").alias("signal"),
        F.pmod(F.xxhash64("id", F.lit(2)), F.lit(101)).cast("double").alias("noise"),
        F.concat(F.lit("person"), F.col("id")).alias("ident"),
        F.date_add(F.lit("2000-01-01").cast("date"), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(900)).cast("int")).alias("day"))


def forest(df, **k):
    return {r.vars: r for r in FO.forest_importances(df, "y", ["k"], **{"num_trees": 40, "seed": 3} | k).collect()}


def test_planted_signal_and_id_like_factor(spark):
    """An id-like text column gets next to nothing and does not lower accuracy."""
    with_ident = forest(planted(spark))
    without = forest(planted(spark).drop("ident"))
    for out in (with_ident, without):
        assert out["signal"].accuracy_fall > 0.15 and abs(out["noise"].accuracy_fall) < 0.02 and abs(out["day"].accuracy_fall) < 0.02
        assert out["signal"].MeanDecreaseAccuracy > 10 > abs(out["noise"].MeanDecreaseAccuracy)
        assert out["signal"].MeanDecreaseGini > 2 * out["noise"].MeanDecreaseGini
    assert abs(with_ident["ident"].accuracy_fall) < 0.01
    assert with_ident["ident"].MeanDecreaseGini < 0.1 * with_ident["signal"].MeanDecreaseGini
    assert with_ident["signal"].oob_accuracy > without["signal"].oob_accuracy - 0.03


def test_same_answer_under_any_partitioning(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = []
        for n in (2, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out = forest(planted(spark, 400).repartition(n), num_trees=10)
            got.append({k: (round(r.MeanDecreaseGini, 9), round(r.accuracy_fall, 12), round(r.oob_accuracy, 12)) for k, r in out.items()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got[0] == got[1]


def test_sampled_bags(spark):
    """Beyond ``sample_rows`` bags are drawn at a lower rate; the signal stays."""
    out = forest(planted(spark, 3000), sample_rows=500)
    assert out["signal"].accuracy_fall > 0.15 and abs(out["noise"].accuracy_fall) < 0.03


def test_odd_frames(spark):
    none = spark.createDataFrame([], "k long, y string, a double, t string")
    assert FO.forest_importances(none, "y", ["k"]).collect() == []
    one = spark.createDataFrame([(1, "p", 1.0, None), (2, "p", None, "x"), (2, "p", None, "x"), (3, None, 2.0, "x")], none.schema)
    out = forest(one, num_trees=5)
    assert {r.MeanDecreaseGini for r in out.values()} == {0.0} and set(out) == {"a", "t"}


def test_factor_encoding_leaves_the_own_fold_out(spark):
    rows = [(k, f"v{k % 7}" if k % 10 else None, float(k % 3 == 0)) for k in range(300)] + [(1000, "alone", 1.0)]
    df = spark.createDataFrame(rows, "k long, c string, y double")
    got = {r.k: r.c for r in FO.encode_factors(df, ["c"], "y", ["k"]).collect()}
    fold = {r.k: r.f for r in df.select("k", FO.hash_fold(["k"], 5).alias("f")).collect()}
    assert set(fold.values()) == set(range(5))
    for k, c, _ in rows:
        rest = [y for i, _, y in rows if fold[i] != fold[k]]
        same = [y for i, d, y in rows if d == c and fold[i] != fold[k]]
        assert math.isclose(got[k], (sum(same) + 10 * sum(rest) / len(rest)) / (len(same) + 10), rel_tol=1e-12)


def test_one_order_for_both_measures(spark):
    wide = spark.createDataFrame([("a", 3.0, 1.0), ("b", 1.0, 9.0), ("c", 2.0, 5.0)], "vars string, MeanDecreaseAccuracy double, MeanDecreaseGini double")
    got = {(r.vars, r.name): (r.vars_ord, r.value) for r in FO.importance_long(wide).collect()}
    assert {k: v[0] for k, v in got.items()} == {(v, m): o for v, o in (("b", 1), ("c", 2), ("a", 3)) for m in ("MeanDecreaseAccuracy", "MeanDecreaseGini")}
    assert got["b", "MeanDecreaseGini"] == (1, 9.0)
