"""Column profile, describe, percentiles, box-plot statistics, correlation.

Means and missing counts are ONE wide aggregation over the table.  Distinct counts melt the
table into (column, value) pairs, two columns wide, and count in two steps.  Exact
percentiles count (group, value) pairs, sort them by range over all tasks, add the counts
up and pick the two values around each rank: no group's values meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provguard.operators.windows import sorted_parts
from provguard.session import compiled_projections, scratch_path, ship_package


def _kind(dt: T.DataType) -> str:
    if isinstance(dt, T.NumericType):
        return "numeric"
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "Date"
    if isinstance(dt, T.BooleanType):
        return "logical"
    return "character"


def profile_columns(df: DataFrame, approx: bool = False, digits: int | None = None,
                    factors: Sequence[str] = ()) -> DataFrame:
    """Per column: type, missing count, complete rate, numeric mean, distinct counts.

    Columns: ``skim_variable, skim_type, n_missing, complete_rate,
    numeric_mean, date_n_unique, character_n_unique``.  ``factors`` names text columns that
    are factors: they have a type of their own and no character count.
    """
    fields = df.schema.fields
    kinds = ["factor" if f.name in factors else _kind(f.dataType) for f in fields]
    counted = [i for i, k in enumerate(kinds) if k in ("Date", "character")]
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(fields):
        c = F.col(f.name)
        aggs.append(F.count_if(c.isNull()).alias(f"m{i}"))
        if kinds[i] == "numeric":
            aggs.append(F.avg(c).cast("double").alias(f"a{i}"))
        elif approx and i in counted:
            aggs.append(F.approx_count_distinct(c).cast("long").alias(f"u{i}"))
    wide = df.agg(*aggs)
    rows = []
    for i, f in enumerate(fields):
        mean = F.col(f"a{i}") if kinds[i] == "numeric" else F.lit(None).cast("double")
        rows.append(F.struct(
            F.lit(i).alias("_i"), F.lit(f.name).alias("skim_variable"), F.lit(kinds[i]).alias("skim_type"),
            F.col(f"m{i}").cast("long").alias("n_missing"),
            (F.lit(1.0) - F.col(f"m{i}") / F.col("_rows")).alias("complete_rate"),
            mean.alias("numeric_mean"),
            (F.col(f"u{i}") if approx and i in counted else F.lit(None).cast("long")).alias("_u")))
    out = wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    if counted and not approx:
        pairs = df.select(F.explode(F.array(*[
            F.struct(F.lit(i).alias("_c"), F.col(fields[i].name).cast("string").alias("_v")) for i in counted])).alias("p")).select("p.*")
        unique = pairs.where(F.col("_v").isNotNull()).distinct().groupBy("_c").agg(F.count(F.lit(1)).alias("_n"))
        out = out.join(unique, F.col("_i") == F.col("_c"), "left").withColumn("_u", F.coalesce("_n", F.when(F.col("_i").isin(counted), 0)))
    is_date = F.col("skim_type") == "Date"
    out = out.select("skim_variable", "skim_type", "n_missing", "complete_rate", "numeric_mean",
                     F.when(is_date, F.col("_u")).alias("date_n_unique"), F.when(~is_date, F.col("_u")).alias("character_n_unique"))
    if digits is not None:
        out = out.withColumns({c: F.round(c, digits)
                               for c in ("complete_rate", "numeric_mean")})
    return out


def completion_table(profile: DataFrame, digits: int = 3) -> DataFrame:
    """The profile as a report: most complete columns first, rates and means rounded."""
    out = profile.withColumns({c: F.round(c, digits) for c in ("complete_rate", "numeric_mean")})
    return out.orderBy(F.col("complete_rate").desc(), "skim_variable")


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Typed describe: ``column, count, mean, stddev, min, max`` per numeric column."""
    cols = columns or [f.name for f in df.schema.fields
                       if isinstance(f.dataType, T.NumericType)]
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"a{i}"),
                 F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"lo{i}"),
                 F.max(x).alias(f"hi{i}")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("count"),
                     F.col(f"a{i}").alias("mean"), F.col(f"s{i}").alias("stddev"),
                     F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"))
            for i, c in enumerate(cols)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def value_counts(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """(*keys, _v, _c): how often each group has each non-null value."""
    x = F.col(column).cast("double")
    return df.where(x.isNotNull()).groupBy(*keys, x.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))


def ranked_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Value counts with each value's first and last rank (from 0) in its group and the group's size:
    (*keys, _v, _c, _first, _last, n, ...).

    The counts are sorted by (keys, value) over range partitions; each part's sum for a group
    gives the parts after it their start, and a running sum inside the part finishes the ranks."""
    keys = list(keys)
    parts = sorted_parts(counts, [*keys, "_v"])
    by_part = parts.groupBy("_pid", *keys).agg(F.sum("_c").alias("_size"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    by_part = by_part.select(F.col("_pid").alias("_p"), *[F.col(k).alias(f"_key_{k}") for k in keys],
                             (F.sum("_size").over(w.orderBy("_pid")) - F.col("_size")).alias("_start"),
                             F.sum("_size").over(w).alias("n"))
    same = F.col("_pid") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    inside = Window.partitionBy("_pid", *keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return (parts.withColumn("_upto", F.sum("_c").over(inside)).join(by_part, same)
            .withColumn("_last", F.col("_start") + F.col("_upto") - 1)
            .withColumn("_first", F.col("_last") - F.col("_c") + 1))


def exact_percentiles(counts: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(*keys, n, q0, q1, ...): percentiles with linear interpolation from value counts; only the
    rows around the wanted ranks leave the sorted parts."""
    keys = list(keys)
    ranked = ranked_counts(counts, keys)
    aggs = []
    near = F.lit(False)
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("n") - 1)
        for name, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("_first") <= rank) & (rank <= F.col("_last"))
            near = near | hit
            aggs.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{name}{i}"))
    picked = ranked.where(near).groupBy(*keys, "n").agg(*aggs)
    out = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("n") - 1)
        part = at - F.floor(at)
        out.append((F.col(f"_lo{i}") * (1 - part) + F.col(f"_hi{i}") * part).alias(f"q{i}"))
    return picked.select(*keys, "n", *out)


def percentiles(df: DataFrame, column: str, probs: Sequence[float],
                keys: Sequence[str] = (), approx: bool = False,
                accuracy: int = 10000) -> DataFrame:
    """Percentiles as rows ``(*keys, p, value)`` (linear interpolation when exact)."""
    arr = F.array(*[F.lit(float(p)) for p in probs])
    if approx:
        wide = df.groupBy(*keys).agg(F.percentile_approx(F.col(column).cast("double"), arr, accuracy).alias("_vals"))
    else:
        wide = exact_percentiles(value_counts(df, keys, column), keys, probs).select(
            *keys, F.array(*[f"q{i}" for i in range(len(probs))]).alias("_vals"))
    pairs = F.arrays_zip(arr.alias("p"), F.col("_vals").alias("value"))
    return wide.select(*keys, F.inline(pairs))


def median_by(df: DataFrame, keys: Sequence[str], column: str, name: str = "median",
              approx: bool = False) -> DataFrame:
    """Median of each group; null for a group without values."""
    if approx:
        return df.groupBy(*keys).agg(F.percentile_approx(F.col(column).cast("double"), 0.5, 10000).alias(name))
    med = exact_percentiles(value_counts(df, keys, column), keys, [0.5])
    med = med.select(*[F.col(k).alias(f"_m_{k}") for k in keys], F.col("q0").alias(name))
    groups = df.select(*keys).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_m_{k}"))
    return groups.join(med, same, "left").select(*keys, name)


def boxplot_stats(df: DataFrame, keys: Sequence[str], column: str, coef: float = 1.5) -> DataFrame:
    """Five-number summary with whiskers and outlier count per group.

    Whiskers are the most extreme values within ``coef`` IQRs of the box.
    The rows are first reduced to ``(group, value, count)`` (map-side partial
    aggregation); quartiles, whiskers and outliers are computed from that table.
    """
    if not keys:
        one = df.withColumn("_all", F.lit(1))
        return boxplot_stats(one, ["_all"], column, coef).drop("_all")
    vc = value_counts(df, keys, column)
    stats = (exact_percentiles(vc, keys, [0.25, 0.5, 0.75])
             .select(*keys, "n", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3")))
    stats = stats.withColumns({
        "iqr": F.col("q3") - F.col("q1"),
        "lower_fence": F.col("q1") - F.lit(coef) * (F.col("q3") - F.col("q1")),
        "upper_fence": F.col("q3") + F.lit(coef) * (F.col("q3") - F.col("q1")),
    })
    fences = stats.select(*keys, "lower_fence", "upper_fence")
    joined = vc.join(fences, list(keys), "inner")
    v = F.col("_v")
    inside = (v >= F.col("lower_fence")) & (v <= F.col("upper_fence"))
    ext = joined.groupBy(*keys).agg(
        F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"),
        F.sum(F.when(~inside, F.col("_c")).otherwise(F.lit(0))).alias("n_outliers"))
    return stats.join(ext, list(keys), "inner")


def corr_long(df: DataFrame, columns: Sequence[str], lower_only: bool = True) -> DataFrame:
    """Pearson correlation of every pair, in long form ``(x, y, r)``.

    One aggregation computes all pairs; ``corr`` skips rows where either side
    is null (pairwise complete).  ``lower_only`` keeps one triangle
    (``shave``): pairs where ``x`` comes after ``y`` in ``columns``.
    """
    cols = list(columns)
    pairs = [(a, b) for i, a in enumerate(cols) for j, b in enumerate(cols)
             if (i > j if lower_only else True)]
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double"))
                    .alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"c{k}").alias("r"))
            for k, (a, b) in enumerate(pairs)]
    return wide.select(F.explode(F.array(*rows)).alias("t")).select("t.*")


def corr_blocks(df: DataFrame, columns: Sequence[str], lower_only: bool = True, block: int = 500) -> DataFrame:
    """``corr_long`` for many columns: pairwise complete moments as masked matrix products.

    A task turns its rows into a matrix with zeros for nulls and a mask, and adds up counts, sums, squares and
    products of every pair of columns by matrix products.  One pass covers ``block`` columns against ``block``
    others, so a task holds six such matrices whatever the number of columns, and up to ``block`` columns take
    one pass.  For accuracy each task takes off a centre of its own, the mean of the first numbers that it sees
    of a column; Spark moves the tasks' sums to a centre they share and adds them by pair.  A pair without two
    complete rows or without spread gives null.

    The tasks' sums are made at once and kept as a scratch table: the rows' columns are computed under
    ``compiled_projections``, which holds for what runs meanwhile only."""
    cols = list(columns)
    spark = df.sparkSession
    numbers = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    ship_package(spark)

    def moments(a: range, b: range):
        width = len(a) if a == b else len(a) + len(b)

        def run(batches):
            total, centre, known = np.zeros((6, len(a), len(b))), np.zeros(width), np.zeros(width, bool)
            for batch in batches:
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
                seen = ~np.isnan(x)
                for k in np.flatnonzero(~known):
                    some = x[np.isfinite(x[:, k]), k]
                    if len(some):  # equal numbers are their own centre, exactly
                        centre[k], known[k] = np.clip(some.mean(), some.min(), some.max()), True
                x = np.where(seen, x - centre, 0.0)
                m = seen.astype(float)
                left = slice(0, len(a))
                right = left if a == b else slice(len(a), None)
                xa, ma, xb, mb = x[:, left], m[:, left], x[:, right], m[:, right]
                total += [ma.T @ mb, xa.T @ mb, (xa * xa).T @ mb, ma.T @ xb, ma.T @ (xb * xb), xa.T @ xb]
            values = [pa.array(list(t), pa.list_(pa.float64())) for t in (*total, np.tile(centre[-len(b):], (len(a), 1)))]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(centre[:len(a)]), *values], names=["i", "cx", *_MOMENTS, "cy"])

        held = numbers.select(*[f"x{i}" for i in (a if a == b else (*a, *b))])
        rows = held.mapInArrow(run, "i int, cx double, " + ", ".join(f"{c} array<double>" for c in (*_MOMENTS, "cy")))
        return rows.withColumn("first", F.lit(b.start))

    cuts = [range(k, min(k + block, len(cols))) for k in range(0, len(cols), block)]
    parts = [moments(a, b) for x, a in enumerate(cuts) for b in cuts[:x + 1]]
    sums = parts[0]
    for p in parts[1:]:
        sums = sums.unionByName(p)
    path = scratch_path(spark, "moments")
    with compiled_projections(spark):
        sums.write.parquet(path)
    sums = spark.read.schema(sums.schema).parquet(path)
    sums = sums.select("i", "cx", "first", F.posexplode(F.arrays_zip(*_MOMENTS, "cy")).alias("j", "m"))
    sums = sums.select("i", (F.col("j") + F.col("first")).alias("j"), "cx", "m.*")
    n, pair = F.col("n"), Window.partitionBy("i", "j")
    # The shared centre of a pair: the tasks' mean centre, exactly theirs where they agree.
    for c in ("cx", "cy"):
        sums = sums.withColumn(f"{c}0", F.min(F.when(n > 0, F.col(c))).over(pair))
        mean = F.try_divide(F.sum(n * (F.col(c) - F.col(f"{c}0"))).over(pair), F.sum(n).over(pair))
        sums = sums.withColumn(f"d{c}", F.col(c) - (F.col(f"{c}0") + mean))
    dx, dy = F.col("dcx"), F.col("dcy")
    moved = {"n": n, "sx": F.col("sx") + n * dx, "sxx": F.col("sxx") + 2 * dx * F.col("sx") + n * dx * dx,
             "sy": F.col("sy") + n * dy, "syy": F.col("syy") + 2 * dy * F.col("sy") + n * dy * dy,
             "sxy": F.col("sxy") + dx * F.col("sy") + dy * F.col("sx") + n * dx * dy}
    pairs = sums.groupBy("i", "j").agg(*[F.sum(v).alias(c) for c, v in moved.items()])
    spread = (n * F.col("sxx") - F.col("sx") ** 2) * (n * F.col("syy") - F.col("sy") ** 2)
    r = F.when((n > 1) & (spread > 0), (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(spread))
    names = F.array(*[F.lit(c) for c in cols])
    pairs = pairs.withColumn("r", r)
    lower = pairs.where("i > j").select(names[F.col("i")].alias("x"), names[F.col("j")].alias("y"), "r")
    if lower_only:
        return lower
    same = pairs.where("i = j").select(names[F.col("i")].alias("x"), names[F.col("j")].alias("y"), "r")
    return lower.union(lower.select(F.col("y").alias("x"), F.col("x").alias("y"), "r")).union(same)


_MOMENTS = ("n", "sx", "sxx", "sy", "syy", "sxy")


def corr_matrix_mllib(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson matrix with MLlib (rows with any null dropped first), long form."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation
    vec = VectorAssembler(inputCols=list(columns), outputCol="_v", handleInvalid="skip")
    m = Correlation.corr(vec.transform(df.select(*columns)), "_v").head()[0].toArray()
    cols = list(columns)
    rows = [(a, b, float(m[i][j])) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "x string, y string, r double")
