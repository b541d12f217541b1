"""Bagged classification forest with out-of-bag importances.

Every draw is a hash, so neither partitions nor row order matter:

* a row's count in a tree's bag is a Poisson draw from (seed, row key, tree); rows with count 0
  are out of that tree's bag;
* the columns a node may split on come from (seed, tree, node);
* a column is permuted inside a tree's out-of-bag rows by the order of (seed, tree, column, row key).

Text columns are factors: a row's level becomes the smoothed mean label of that level over the rows
of *other* hash folds, so no row's own label enters, and a level that stands in one fold only says
nothing.  Numbers and dates are cut into bins of equal counts (exact, by a distributed sort).

Rows go to the trees that drew them in packed arrays, one shuffle; a tree is grown, scored on
its out-of-bag rows and scored again with each column permuted in one task.  That task holds at most
about ``2 * sample_rows`` rows: on longer tables a bag and its out-of-bag rows are drawn
at the rate that gives ``sample_rows`` each (the study's forest has the same setting as ``sampsize``).  Only
sums for each tree and column leave a task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provguard.operators.profile import ranked_counts
from provguard.session import ensure_checkpoint_dir, ship_package

_LEVEL_NULL = "\0null"


# --- factors --------------------------------------------------------------------

def hash_fold(key: Sequence[str], folds: int, seed: int = 0) -> Column:
    """A fold from the first 32 bits of ``md5(seed:key)``; parts of the key are joined by a bar."""
    text = F.concat_ws("|", F.lit(f"{seed}:"), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def encode_factors(df: DataFrame, columns: Sequence[str], label: str, key: Sequence[str], folds: int = 5,
                   smoothing: float = 10.0, seed: int = 0) -> DataFrame:
    """Text columns as numbers: mean of ``label`` over the rows of the level in other folds.

    ``(sum + smoothing * overall) / (count + smoothing)``, where ``overall`` too is the mean over other folds.
    Null is a level.  One grouped pass counts (column, level, fold); the levels of all columns join
    by shuffle, and no level reaches the driver."""
    if not columns:
        return df
    ensure_checkpoint_dir(df.sparkSession)
    tagged = df.withColumn("_fold", hash_fold(key, folds, seed))
    melted = tagged.select("_fold", F.col(label).cast("double").alias("_y"), F.explode(F.array(
        F.struct(F.lit("").alias("_c"), F.lit("").alias("_v")),  # all rows together, for the overall mean
        *[F.struct(F.lit(c).alias("_c"), F.coalesce(F.col(c), F.lit(_LEVEL_NULL)).alias("_v")) for c in columns])).alias("_p"))
    by_fold = melted.groupBy("_p._c", "_p._v", "_fold").agg(F.sum("_y").alias("_s"), F.count("_y").alias("_n"))
    # For each level, its total and its sums by fold (at most ``folds`` of them).
    levels = by_fold.groupBy("_c", "_v").agg(
        F.sum("_s").alias("_s"), F.sum("_n").alias("_n"),
        F.map_from_entries(F.collect_list(F.struct("_fold", F.struct("_s", "_n")))).alias("_own")).checkpoint()  # counted once, read for each column
    every = levels.where(F.col("_c") == "").select("_s", "_n", "_own")
    total, count, own = (every.select(c).scalar() for c in ("_s", "_n", "_own"))
    mine = F.try_element_at(own, F.col("_fold"))
    overall = F.coalesce(F.try_divide(total - F.coalesce(mine["_s"], F.lit(0.0)), count - F.coalesce(mine["_n"], F.lit(0))), F.lit(0.0))
    out = tagged.withColumn("_overall", overall)
    for c in columns:
        m = levels.where(F.col("_c") == c).select(F.col("_v").alias("_level"), "_s", "_n", "_own")
        out = out.withColumn("_key", F.coalesce(F.col(c), F.lit(_LEVEL_NULL))).join(m, F.col("_key") == F.col("_level"), "left")
        mine = F.try_element_at("_own", F.col("_fold"))
        s = F.coalesce(F.col("_s"), F.lit(0.0)) - F.coalesce(mine["_s"], F.lit(0.0))
        n = F.coalesce(F.col("_n"), F.lit(0)) - F.coalesce(mine["_n"], F.lit(0))
        value = (s + F.lit(float(smoothing)) * F.col("_overall")) / (n + F.lit(float(smoothing)))
        out = out.withColumn(c, value).drop("_key", "_level", "_s", "_n", "_own")
    return out.drop("_fold", "_overall")


# --- bins -------------------------------------------------------------------------

def bin_edges(df: DataFrame, columns: Sequence[str], bins: int) -> list[np.ndarray]:
    """For each column the upper values of at most ``bins`` bins of about equal counts, but the last."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("_col"), F.col(c).cast("double").alias("_v"))
                                          for i, c in enumerate(columns)])).alias("_p")).select("_p.*")
    counts = pairs.where(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy("_col", "_v").agg(F.count(F.lit(1)).alias("_c"))
    ranked = ranked_counts(counts, ["_col"])
    rows = (ranked.withColumn("_bin", F.floor(F.col("_first") * bins / F.col("n")))
            .groupBy("_col", "_bin").agg(F.max("_v").alias("_upper")).collect())  # at most bins for each column
    out = []
    for i in range(len(columns)):
        out.append(np.array(sorted(r["_upper"] for r in rows if r["_col"] == i)[:-1]))
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Rows of numbers -> bins (0 for NaN, else 1 + how many upper values are below)."""
    out = np.empty(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.where(np.isnan(x[:, j]), 0, 1 + np.searchsorted(e, x[:, j], "left"))
    return out


# --- draws ------------------------------------------------------------------------

def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element-wise."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def draws(seed: int, keys: np.ndarray, *salts: int) -> np.ndarray:
    """One 64-bit draw for each key, another for other salts."""
    h = mixed(np.asarray(keys).astype(np.int64).view(np.uint64) + np.uint64(seed * 2 + 1))
    for s in salts:
        h = mixed(h + mixed(np.array([s + 1], np.uint64)))
    return h


def bag_counts(seed: int, keys: np.ndarray, tree: int, rate: float) -> np.ndarray:
    """Poisson(rate) counts by inversion of a uniform hash draw."""
    u = (draws(seed, keys, tree) >> np.uint64(11)).astype(float) / (1 << 53)
    term, steps = np.exp(-rate), []
    total = term
    for k in range(1, 12):
        steps.append(total)
        term *= rate / k
        total += term
    return np.searchsorted(np.array(steps), u, "right")


# --- one tree ---------------------------------------------------------------------

def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, tree: int, seed: int, mtry: int, max_depth: int):
    """A tree on binned rows with counts ``w``: (column, bin, first child, class) of each node, and each
    column's fall of impurity.  Nodes of a level are split together; a node stays whole if it is pure or no
    drawn column lowers its impurity."""
    p, width = x.shape[1], int(x.max(initial=0)) + 1
    column, cut, child, klass = [np.full(1, -1)], [np.zeros(1, int)], [np.zeros(1, int)], []
    fall = np.zeros(p)
    node, base, size = np.zeros(len(y), int), 0, 1  # the level's nodes are base .. base + size
    w = w.astype(float)
    for depth in range(max_depth + 1):
        total = np.bincount(node * classes + y, w, size * classes).reshape(size, classes)
        n = total.sum(1)
        ids = base + np.arange(size)
        tie = draws(seed, ids, tree, 1)[:, None] + np.arange(classes, dtype=np.uint64)
        klass.append(np.lexsort((mixed(tie), total), axis=1)[:, -1] if size else np.zeros(0, int))
        if depth == max_depth or not size:
            break
        order = draws(seed, np.repeat(ids, p) * p + np.tile(np.arange(p), size), tree, 2).reshape(size, p)
        tried = np.argsort(order, axis=1, kind="stable")[:, :mtry]
        whole = (total ** 2).sum(1) / n
        best, best_column, best_cut = np.full(size, 0.0), np.full(size, -1), np.zeros(size, int)
        for j in range(mtry):
            b = x[np.arange(len(y)), tried[node, j]]
            left = np.bincount((node * width + b) * classes + y, w, size * width * classes).reshape(size, width, classes).cumsum(1)
            right = total[:, None, :] - left
            n_left, n_right = left.sum(2), right.sum(2)
            with np.errstate(divide="ignore", invalid="ignore"):
                score = (left ** 2).sum(2) / n_left + (right ** 2).sum(2) / n_right
            score = np.where((n_left > 0) & (n_right > 0), score - whole[:, None], 0.0)
            at = score.argmax(1)
            gain = score[np.arange(size), at]
            better = gain > best + 1e-9 * n
            best, best_column, best_cut = np.where(better, gain, best), np.where(better, tried[:, j], best_column), np.where(better, at, best_cut)
        split = best_column >= 0
        np.add.at(fall, best_column[split], best[split])
        new = np.cumsum(split) - split
        column[-1][:], cut[-1][:] = best_column, best_cut
        child[-1][:] = np.where(split, base + size + 2 * new, 0)
        go = split[node]
        x, y, w, node = x[go], y[go], w[go], node[go]
        node = 2 * new[node] + (x[np.arange(len(y)), best_column[node]] > best_cut[node])
        base, size = base + size, 2 * int(split.sum())
        if not size:
            break
        column.append(np.full(size, -1))
        cut.append(np.zeros(size, int))
        child.append(np.zeros(size, int))
    return (*map(np.concatenate, (column, cut, child, klass)), fall)


def predict(tree, x: np.ndarray) -> np.ndarray:
    column, cut, child, klass, _ = tree
    node = np.zeros(len(x), int)
    while True:
        inner = np.flatnonzero(column[node] >= 0)
        if not len(inner):
            return klass[node]
        at = node[inner]
        node[inner] = child[at] + (x[inner, column[at]] > cut[at])


def tree_importances(tree_id: int, keys: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, seed: int,
                     mtry: int, max_depth: int) -> tuple[np.ndarray, int, int, np.ndarray]:
    """(fall of impurity by column, out-of-bag rows, of these right, right with each column permuted)."""
    order = np.lexsort((*x.T, y, keys))
    keys, x, y, w = keys[order], x[order], y[order], w[order]
    bag, out = w > 0, w == 0
    tree = grow(x[bag], y[bag], w[bag], classes, tree_id, seed, mtry, max_depth)
    z, truth, ids = x[out], y[out], keys[out]
    right = int((predict(tree, z) == truth).sum())
    permuted = np.full(x.shape[1], right)
    for j in np.unique(tree[0][tree[0] >= 0]).tolist():
        moved = z.copy()
        moved[:, j] = z[np.argsort(draws(seed, ids, tree_id, 3, j), kind="stable"), j]
        permuted[j] = int((predict(tree, moved) == truth).sum())
    return tree[4], len(truth), right, permuted


# --- the forest -------------------------------------------------------------------

def factor_frame(df: DataFrame, label: str, key: Sequence[str], names: Sequence[str], seed: int) -> tuple[DataFrame, list[str]]:
    """(row key hash, class number, columns as doubles) of labelled rows, and the columns."""
    feats = [c for c in df.columns if c != label and c not in key]
    out = df.where(F.col(label).isNotNull()).withColumn(
        "_y", F.array_position(F.array(*[F.lit(x) for x in names]), F.col(label).cast("string")).cast("int") - 1)
    for f in df.schema.fields:
        if f.name in feats and isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out = out.withColumn(f.name, F.unix_date(F.col(f.name).cast("date")))
    text = [f.name for f in out.schema.fields if f.name in feats and isinstance(f.dataType, T.StringType)]
    out = encode_factors(out, text, "_y", key, seed=seed)
    return out.select(F.xxhash64(*key).alias("_key"), "_y", *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(feats)]), feats


def forest_importances(df: DataFrame, label: str, key: Sequence[str], num_trees: int = 500, max_depth: int = 30,
                       seed: int = 0, bins: int = 64, sample_rows: int = 100_000, mtry: int | None = None) -> DataFrame:
    """(vars, MeanDecreaseAccuracy, MeanDecreaseGini, accuracy_fall, oob_accuracy) of one forest.

    * ``accuracy_fall``: mean over trees of the share of out-of-bag rows that a permuted column turns wrong;
    * ``MeanDecreaseAccuracy``: the same divided by its standard error over the trees (undivided where
      that is 0), as the study's package gives it;
    * ``MeanDecreaseGini``: fall of impurity, counted in rows, added up over a tree's splits, mean over trees.

    ``key`` names a row; its draws hang on it.  Classes are the distinct labels; rows without a label take no part;
    a null number is a bin of its own.  ``mtry`` defaults to the root of the number of columns."""
    if not 1 < bins < 255:
        raise ValueError("2 to 254 bins")
    schema = "vars string, MeanDecreaseAccuracy double, MeanDecreaseGini double, accuracy_fall double, oob_accuracy double"
    spark = df.sparkSession
    names = [r[0] for r in df.select(F.col(label).cast("string")).where(F.col(label).isNotNull()).distinct().orderBy(label).collect()]
    if not names:
        return spark.createDataFrame([], schema)
    data, feats = factor_frame(df, label, key, names, seed)
    ensure_checkpoint_dir(spark)
    data = data.checkpoint()  # factors are joined once; every later pass reads their rows
    p, classes = len(feats), len(names)
    n = data.count()
    edges = bin_edges(data, [f"_x{i}" for i in range(p)], bins)
    rate = min(1.0, sample_rows / n)
    columns = mtry or max(1, int(p ** 0.5))
    ship_package(spark)

    def deal(batches):
        for b in batches:
            keys, y = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            x = binned(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[2:]], 1).astype(float), edges)
            rows = []
            for t in range(num_trees):
                w = bag_counts(seed, keys, t, rate)
                seen = (w > 0) if rate == 1 else (w > 0) | (draws(seed, keys, t, 4) >> np.uint64(11) < np.uint64(int(rate * (1 << 53))))
                at = np.arange(len(w)) if rate == 1 else np.flatnonzero(seen)
                if len(at):
                    rows.append((t, keys[at].tobytes(), y[at].astype(np.int32).tobytes(), w[at].astype(np.uint8).tobytes(), x[at].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, (pa.int32(), *[pa.binary()] * 4))],
                                             names=["tree", "keys", "y", "w", "x"])

    def one_tree(group, rows):
        part = [b"".join(rows[c].to_pylist()) for c in ("keys", "y", "w", "x")]
        t, keys = group[0].as_py(), np.frombuffer(part[0], np.int64)
        fall, n_out, right, permuted = tree_importances(
            t, keys, np.frombuffer(part[3], np.uint8).reshape(len(keys), p), np.frombuffer(part[1], np.int32).astype(int),
            np.frombuffer(part[2], np.uint8).astype(int), classes, seed, columns, max_depth)
        return pa.table({"tree": pa.array([t] * p, pa.int32()), "j": pa.array(range(p), pa.int32()), "fall": fall, "n_out": pa.array([n_out] * p, pa.int64()),
                         "n_right": pa.array([right] * p, pa.int64()), "n_permuted": pa.array(permuted, pa.int64())})

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    dealt = data.mapInArrow(deal, "tree int, keys binary, y binary, w binary, x binary").repartition(min(tasks, num_trees), "tree")
    trees = dealt.groupBy("tree").applyInArrow(one_tree, "tree int, j int, fall double, n_out long, n_right long, n_permuted long")
    lost = F.try_divide(F.col("n_right") - F.col("n_permuted"), F.col("n_out"))
    by_column = trees.groupBy("j").agg(
        F.avg(lost).alias("accuracy_fall"), F.sqrt(F.var_pop(lost) / F.count(lost)).alias("_se"),
        F.avg("fall").alias("MeanDecreaseGini"), F.avg(F.try_divide("n_right", "n_out")).alias("oob_accuracy"))
    vars_ = F.array(*[F.lit(c) for c in feats])[F.col("j")]
    scaled = F.col("accuracy_fall") / F.when(F.col("_se") < 1e-12, 1.0).otherwise(F.col("_se"))
    return by_column.select(vars_.alias("vars"), scaled.alias("MeanDecreaseAccuracy"), "MeanDecreaseGini", "accuracy_fall", "oob_accuracy")


def importance_long(wide: DataFrame) -> DataFrame:
    """The ``Mean*`` columns in long form: (vars, vars_ord, name, value).  Variables are ordered once, by
    ``MeanDecreaseAccuracy``, and keep that order in both measures."""
    order = F.dense_rank().over(Window.orderBy("MeanDecreaseAccuracy")).cast("long")  # one row a variable
    return wide.withColumn("vars_ord", order).unpivot(
        ["vars", "vars_ord"], ["MeanDecreaseAccuracy", "MeanDecreaseGini"], "name", "value")
