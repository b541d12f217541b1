"""Splits, formulas and models (MLlib).

* Splits are keyed by a hash of the row key, so a row's side never depends on
  partitioning (``randomSplit`` changes after a repartition).
* Models are MLlib estimators; each fit is a distributed pass (or a few).
* Summaries are turned into small DataFrames of one row per term.
* The forest and its importances are in ``forest.py``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import RFormula, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provguard.functions.exprs import col
from provguard.session import ensure_checkpoint_dir


# --- splits ------------------------------------------------------------------

def hash_split_label(key: str | Column, train_fraction: float = 0.5, seed: int = 0,
                     names: tuple[str, str] = ("training", "test")) -> Column:
    """``training`` / ``test`` from the first 60 bits of ``md5(seed:key)``.

    The split is stable under any repartitioning; a null key counts as empty text.
    """
    key = F.coalesce(col(key).cast("string"), F.lit(""))
    h = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 15)
    cut = round(train_fraction * (1 << 60))
    if cut >= 1 << 60:
        return F.lit(names[0])
    return F.when(h < F.lit(format(cut, "015x")), F.lit(names[0])).otherwise(F.lit(names[1]))


def hash_split(df: DataFrame, key: str | Sequence[str], train_fraction: float = 0.5,
               seed: int = 0) -> tuple[DataFrame, DataFrame]:
    keys = [key] if isinstance(key, str) else list(key)
    k = keys[0] if len(keys) == 1 else F.concat_ws("|", *[F.col(c).cast("string") for c in keys])
    lab = hash_split_label(k, train_fraction, seed)
    tagged = df.withColumn("_split", lab)
    return (tagged.where(F.col("_split") == "training").drop("_split"),
            tagged.where(F.col("_split") == "test").drop("_split"))


# --- formulas ----------------------------------------------------------------

def fill_numeric_nulls(df: DataFrame, value: float = 0.0) -> DataFrame:
    """Pivoted features leave nulls for absent codes; formulas need numbers."""
    nums = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return df.na.fill(value, subset=nums) if nums else df


def _formula(formula: str, drop: Sequence[str]) -> str:
    return formula + "".join(f" - `{d}`" if not d.isidentifier() else f" - {d}" for d in drop)


def formula_features(df: DataFrame, formula: str, drop: Sequence[str] = (),
                     keep: Sequence[str] = ()) -> DataFrame:
    """``label ~ . - x`` to ``(label, features)`` with RFormula (nulls filled)."""
    data = fill_numeric_nulls(df)
    rf = RFormula(formula=_formula(formula, drop), featuresCol="features", labelCol="label",
                  handleInvalid="keep", stringIndexerOrderType="alphabetAsc")
    return rf.fit(data).transform(data).select(*keep, "label", "features")


def feature_sums(data: DataFrame) -> DataFrame:
    """Each term's features added up over all rows: (term, total, n_rows)."""
    names = _terms(data)
    table = F.create_map(*[x for i, t in enumerate(names) for x in (F.lit(i), F.lit(t))])
    return (data.select(F.posexplode(vector_to_array("features")).alias("_i", "_x")).groupBy("_i")
            .agg(F.round(F.sum("_x"), 3).alias("total"), F.count(F.lit(1)).alias("n_rows"))
            .select(table[F.col("_i")].alias("term"), "total", "n_rows"))


# --- linear models -------------------------------------------------------------

def ols_one(df: DataFrame, y: str, x: str, digits: tuple[int, int, int] = (4, 4, 6)) -> DataFrame:
    """One-feature least squares: slope, intercept and R squared as one row."""
    data = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    vec = VectorAssembler(inputCols=[x], outputCol="_f").transform(data)
    m = LinearRegression(featuresCol="_f", labelCol=y, solver="normal", regParam=0.0).fit(vec)
    row = (round(float(m.coefficients[0]), digits[0]), round(float(m.intercept), digits[1]),
           round(float(m.summary.r2), digits[2]))
    return df.sparkSession.createDataFrame([row], "slope double, intercept double, r2 double")


def _terms(model_frame: DataFrame, features_col: str = "features") -> list[str]:
    meta = model_frame.schema[features_col].metadata.get("ml_attr", {})
    attrs = []
    for group in meta.get("attrs", {}).values():
        attrs.extend(group)
    attrs.sort(key=lambda a: a["idx"])
    return [a.get("name", f"x{a['idx']}") for a in attrs]


def fit_linear(df: DataFrame, formula: str, key: Sequence[str], seed: int = 0,
               train_fraction: float = 0.5):
    """Least squares on the hash-split training side: (fitted formula, model, test side)."""
    train, test = hash_split(df, key, train_fraction, seed)
    rf = RFormula(formula=formula, featuresCol="features", labelCol="label").fit(train)
    data = rf.transform(train)
    return rf, LinearRegression(featuresCol="features", labelCol="label", solver="normal").fit(data), test


def fit_linear_predict(df: DataFrame, formula: str, key: Sequence[str], seed: int = 0,
                       train_fraction: float = 0.5) -> DataFrame:
    """Fit least squares on the hash-split training side; predict the test side."""
    rf, model, test = fit_linear(df, formula, key, seed, train_fraction)
    return model.transform(rf.transform(test)).select(*key, "label", "prediction")


def linear_summary(df: DataFrame, formula: str) -> DataFrame:
    """Least-squares terms: ``term, estimate, std_err, t_value, p_value``."""
    data = RFormula(formula=formula).fit(df).transform(df)
    m = LinearRegression(solver="normal").fit(data)
    s = m.summary
    names = _terms(data) + ["(Intercept)"]
    est = list(m.coefficients) + [m.intercept]
    rows = [(n, float(e), float(se), float(t), float(p)) for n, e, se, t, p in
            zip(names, est, s.coefficientStandardErrors, s.tValues, s.pValues)]
    return df.sparkSession.createDataFrame(
        rows, "term string, estimate double, std_err double, t_value double, p_value double")


def glm_summary(df: DataFrame, formula: str, family: str = "gaussian",
                link: str = "identity") -> DataFrame:
    """Generalised linear model terms as rows, plus deviance and AIC columns."""
    data = RFormula(formula=formula).fit(df).transform(df)
    m = GeneralizedLinearRegression(family=family, link=link).fit(data)
    s = m.summary
    names = _terms(data) + ["(Intercept)"]
    est = list(m.coefficients) + [m.intercept]
    rows = [(n, float(e), float(se), float(t), float(p), float(s.deviance), float(s.aic))
            for n, e, se, t, p in zip(names, est, s.coefficientStandardErrors,
                                      s.tValues, s.pValues)]
    return df.sparkSession.createDataFrame(
        rows, "term string, estimate double, std_err double, t_value double, "
              "p_value double, deviance double, aic double")


# --- classification -----------------------------------------------------------

def class_weights(df: DataFrame, label: str = "label", name: str = "weight") -> DataFrame:
    """Balanced weights ``n / (k * n_class)`` as a column (k classes; a null label is none
    of them and gets a null weight)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("_class")).agg(F.count(F.lit(1)).alias("_nc"))
    total, k = counts.agg(F.sum("_nc"), F.count(F.lit(1))).first()  # two numbers
    w = counts.select("_class", (F.lit(total or 0) / (F.lit(max(k, 1)) * F.col("_nc"))).alias(name))
    return df.join(w, df[label] == w["_class"], "left").drop("_class")


def prepare_logistic(df: DataFrame, formula: str, drop: Sequence[str] = (), vectors: Sequence[str] = (), balanced: bool = True) -> DataFrame:
    """Rows with ``label``, ``features`` and ``weight`` (1 unless ``balanced``).

    ``vectors`` names columns that are vectors already (see ``sparse.py``); they stand after the formula's terms."""
    named = formula.split("~")[0].strip().strip("`")
    ensure_checkpoint_dir(df.sparkSession)
    # Features are often a pivot over all claims: made once, then read by every pass.
    data = fill_numeric_nulls(df.where(F.col(f"`{named}`").isNotNull())).checkpoint()
    if isinstance(df.schema[named].dataType, T.StringType):  # classes in the order of their names
        classes = [r[0] for r in data.select(F.col(f"`{named}`")).distinct().collect()]
        rank = F.array_position(F.array(*[F.lit(c) for c in sorted(classes)]), F.col(f"`{named}`")) - 1
        data = data.withColumn(named, rank.cast("double") if classes else F.lit(None).cast("double"))
    rf = RFormula(formula=_formula(formula, drop), featuresCol="features", labelCol="label",
                  handleInvalid="keep", stringIndexerOrderType="alphabetAsc")
    data = rf.fit(data.drop(*vectors)).transform(data)
    if vectors:
        data = (VectorAssembler(inputCols=["features", *vectors], outputCol="_all").transform(data)
                .drop("features", *vectors).withColumnRenamed("_all", "features"))
    return class_weights(data) if balanced else data.withColumn("weight", F.lit(1.0))


def fit_logistic(df: DataFrame, formula: str, drop: Sequence[str] = (), max_iter: int = 100,
                 tol: float = 1e-6, vectors: Sequence[str] = (), balanced: bool = True):
    """Logistic regression on the label, classes weighted alike if ``balanced``: (rows with
    features and weight, model).

    Labels of one class only leave nothing to fit: the model is None.
    ``max_iter`` is MLlib's default of 100; a fit that stops there has not converged and
    raises an error."""
    prepared = prepare_logistic(df, formula, drop, vectors, balanced)
    prepared = prepared.persist(StorageLevel.MEMORY_AND_DISK)  # a pass per iteration
    try:
        low, high = prepared.agg(F.min("label"), F.max("label")).first()
        if low == high:
            return prepared, None
        model = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight",
                                   maxIter=max_iter, tol=tol).fit(prepared)
        if model.summary.totalIterations >= max_iter:
            raise RuntimeError(f"no convergence in {max_iter} iterations")
    finally:
        prepared.unpersist()
    return prepared, model


def information(prepared: DataFrame, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score vector and Fisher information X'WX of a logistic fit at ``beta`` (the intercept last).

    Each task adds up its rows block by block, as p x p products, and sends p + 1 rows; Spark adds
    these by (row, column).  p * p numbers reach the driver, as with any normal equations."""
    p = len(beta)

    def run(batches):
        total = np.zeros((p + 1, p))
        for b in batches:
            x = b.column(0).combine_chunks() if isinstance(b.column(0), pa.ChunkedArray) else b.column(0)
            x = np.column_stack([x.flatten().to_numpy().reshape(b.num_rows, p - 1), np.ones(b.num_rows)])
            y, w = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            fit = 1 / (1 + np.exp(-x @ beta))
            total[:p] += (x * (w * fit * (1 - fit))[:, None]).T @ x
            total[p] += x.T @ (w * (y - fit))
        yield pa.RecordBatch.from_arrays([pa.array(range(p + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    rows = prepared.select(vector_to_array("features").alias("x"), F.col("label").cast("double"), F.col("weight").cast("double"))
    sums = (rows.mapInArrow(run, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
            .groupBy("i", "j").agg(F.sum("v")).collect())
    out = np.zeros((p + 1, p))
    for i, j, v in sums:
        out[i, j] = v
    return out[p], out[:p]


def logistic_terms(df: DataFrame, formula: str, drop: Sequence[str] = (), max_iter: int = 100, newton: int = 3,
                   balanced: bool = False) -> DataFrame:
    """The coefficient table of a logistic fit: ``term, estimate, std_err, z_value, p_value``.

    MLlib's estimates are brought to the score equations' root by ``newton`` steps with the Fisher
    information, whose inverse at the end gives the standard errors.  Directions that the data do not
    fix (terms that add up to others) keep MLlib's estimate and get a null error.  Labels of one class give null estimates.
    The information has a row and a column for each term, so this is for thousands of terms, not
    for codes without bound."""
    prepared, model = fit_logistic(df, formula, drop, max_iter, balanced=balanced)
    names = [*_terms(prepared), "(Intercept)"]
    schema = "term string, estimate double, std_err double, z_value double, p_value double"
    if model is None:
        return df.sparkSession.createDataFrame([(t, None, None, None, None) for t in names], schema)
    beta = np.append(model.coefficients.toArray(), model.intercept)
    prepared = prepared.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for _ in range(newton):
            score, info = information(prepared, beta)
            beta = beta + np.linalg.pinv(info, rcond=1e-12, hermitian=True) @ score
        _, info = information(prepared, beta)
    finally:
        prepared.unpersist()
    scale = np.sqrt(np.where(np.diag(info) > 0, np.diag(info), 1.0))
    size, axes = np.linalg.eigh(info / np.outer(scale, scale))
    free = size < 1e-10 * size.max()
    variance = ((axes[:, ~free] ** 2) / size[~free]).sum(1) / scale ** 2
    fixed = (axes[:, free] ** 2).sum(1) < 1e-8
    rows = []
    for t, b, v, ok in zip(names, beta.tolist(), variance.tolist(), fixed.tolist()):
        se = math.sqrt(v) if ok and v > 0 else None
        rows.append((t, b, se, b / se if se else None, math.erfc(abs(b / se) / math.sqrt(2)) if se else None))
    return df.sparkSession.createDataFrame(rows, schema)


def predict_logistic(prepared: DataFrame, model) -> DataFrame:
    """``prediction`` and ``p_positive`` of every row; without a model both are the only label."""
    if model is None:
        return prepared.withColumns({"prediction": F.col("label"), "p_positive": F.col("label")})
    return model.transform(prepared).withColumn("p_positive", vector_to_array("probability")[1])


def fit_logistic_predict(df: DataFrame, formula: str, drop: Sequence[str] = (), key: str = "rndrng_npi",
                         max_iter: int = 100, tol: float = 1e-6, vectors: Sequence[str] = ()) -> DataFrame:
    """Weighted logistic regression on the label; per-row positive probability."""
    prepared, model = fit_logistic(df, formula, [key, *drop], max_iter, tol, vectors)
    return predict_logistic(prepared, model).select(key, "label", "prediction", "p_positive")


def logistic_scores(df: DataFrame, formula: str, drop: Sequence[str] = (), max_iter: int = 100) -> DataFrame:
    """(term, score, scale): weighted sums of residual times feature, zero for a fit without
    penalty but for its tolerance; ``scale`` is the weighted sum of the feature's sizes."""
    prepared, model = fit_logistic(df, formula, drop, max_iter)
    names = [*_terms(prepared), "(Intercept)"]
    table = F.create_map(*[x for i, t in enumerate(names) for x in (F.lit(i), F.lit(t))])
    residual = F.col("weight") * (F.col("label") - F.col("p_positive"))
    rows = predict_logistic(prepared, model).select(residual.alias("_r"), "weight", F.posexplode(F.concat(vector_to_array("features"), F.array(F.lit(1.0)))).alias("_i", "_x"))
    return (rows.groupBy("_i").agg(F.sum(F.col("_r") * F.col("_x")).alias("score"), F.sum(F.col("weight") * F.abs("_x")).alias("scale"))
            .select(table[F.col("_i")].alias("term"), "score", "scale"))
