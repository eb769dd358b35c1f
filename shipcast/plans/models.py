"""Model fitting and scoring on MLlib.

Regression: ordinary least squares with an R-style summary, linear models
compared on train/test, random-forest depth and tree-count sweeps.
Classification: logistic regression, random forests, Gaussian naive Bayes.
Features are assembled once into a vector column and persisted while a sweep
fits several models over them; training runs on executors (MLlib's tree and
normal-equation aggregations), only fitted parameters (p numbers) come back.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import levels as L
from ..operators.distributions import group_quantiles
from ..session import cut_lineage
from .leastsquares import INTERCEPT, LeastSquares, least_squares, t_two_sided
from .forest import class_votes, forest_table, sent_trees, sent_voters, staged_predictions, staged_scores

SEED = 42


def assemble(df: DataFrame, cols: list[str], out: str = "features", keep: list[str] = ()) -> DataFrame:
    """Vector column of ``cols`` (numeric or vector columns); rows with a
    missing predictor are dropped."""
    types = dict(df.dtypes)
    sel = [F.col(c) if isinstance(df.schema[c].dataType, VectorUDT) or types[c] == "vector"
           else F.col(c).cast("double").alias(c) for c in cols]
    base = df.select(*keep, *sel).dropna(subset=cols)
    return VectorAssembler(inputCols=cols, outputCol=out).transform(base).select(*keep, out)


def encode_levels(frames: list[DataFrame], levels: DataFrame, suffix: str = "__ohe",
                  key: str = "Rww_ID") -> tuple[list[DataFrame], list[str], list[str]]:
    """One sparse indicator vector per variable for the listed levels only.

    ``levels`` is a table (variabl, ctgry_lvl); levels are compared as strings.
    A vector has one slot per listed level, in alphabetical order; any other
    level, a missing one, or one unseen in training is a vector of zeros.  The
    slots of all variables come from one dictionary in one step.

    Returns the frames, the new columns, and the name ``<var>=<level>`` of every
    slot, in the order in which the assembled vectors have them.
    """
    dictionary = L.level_dictionary(levels)
    listed: dict[str, list[str]] = {}
    for r in dictionary.orderBy("variabl", "slot").collect():  # a name for every slot; the dictionary's size is bounded
        listed.setdefault(r["variabl"], []).append(r["ctgry_lvl"])
    if not listed:
        return list(frames), [], []
    variables = list(listed)
    slots = [f"{v}__slot" for v in variables]
    # category sizes come from one row holding each variable's last slot
    last = dictionary.sparkSession.createDataFrame([tuple(float(len(v) - 1) for v in listed.values())],
                                                   ", ".join(f"`{s}` double" for s in slots))
    encoder = OneHotEncoder(inputCols=slots, outputCols=[v + suffix for v in variables], dropLast=True,
                            handleInvalid="keep").fit(last)
    out = []
    for df in frames:
        found = L.with_slots(df, dictionary, variables, key)
        # a slot past the last is invalid to the encoder, which writes zeros for it
        ready = found.select(*df.columns, *[F.coalesce(F.col(s).cast("double"), F.lit(float(len(listed[v])))).alias(s)
                                            for v, s in zip(variables, slots)])
        out.append(encoder.transform(ready).drop(*slots))
    return out, [v + suffix for v in variables], [f"{v}={lvl}" for v in variables for lvl in listed[v]]


# --- ordinary least squares ---------------------------------------------------------

@dataclass
class OlsFit:
    model: LeastSquares
    predictors: list[str]
    label: str
    n: int
    coefficients: DataFrame   # term, estimate, std_error, t_value, p_value
    stats: dict


def ols(df: DataFrame, label: str, predictors: list[str], log_label: bool = False) -> OlsFit:
    """OLS of label (or ln(label)) on predictors with an R-like summary:
    coefficients, standard errors, t and p values, R^2, adjusted R^2, F.
    Rows with a missing value are left out (as ``na.omit``); with ``log_label``
    non-positive labels are left out too."""
    y = F.col(label).cast("double")
    base = df.where(y > 0) if log_label else df
    m = least_squares(base.withColumn("_y", F.ln(y) if log_label else y), "_y", predictors)
    n, p, r2 = m.n, len(predictors), m.r2
    stats = {"n": n, "r2": r2, "r2adj": 1 - (1 - r2) * (n - 1) / (n - p - 1),
             "f_stat": (r2 / p) / ((1 - r2) / (n - p - 1)) if r2 < 1 else math.inf, "sigma": m.sigma}
    rows = []
    for term, c, e in zip([INTERCEPT, *predictors], m.beta.tolist(), m.std_errors().tolist()):
        t = c / e if e else math.inf
        rows.append((term, c, e, t, t_two_sided(t, m.dof)))
    table = df.sparkSession.createDataFrame(rows[1:] + rows[:1], "term string, estimate double, std_error double, "
                                                                 "t_value double, p_value double")
    return OlsFit(m, predictors, label, n, table, stats)


def ols_table(fit: OlsFit) -> DataFrame:
    """Coefficient table with the model statistics repeated per row."""
    st = fit.stats
    return fit.coefficients.select(
        "term", "estimate", "std_error", "t_value", "p_value",
        F.lit(st["n"]).cast("bigint").alias("n"), F.lit(st["r2"]).alias("r2"),
        F.lit(st["r2adj"]).alias("r2adj"), F.lit(st["f_stat"]).alias("f_stat"))


def residual_diagnostics(df: DataFrame, fit: OlsFit, key: str) -> DataFrame:
    """Per row: fitted, residual, leverage h = x'(X'X)^-1 x, standardized residual
    e / (sigma sqrt(1 - h)).  The leverage comes from the triangular factor of the
    fit, as a sum of squares of column expressions."""
    base = df.where(F.col(fit.label).isNotNull()).dropna(subset=fit.predictors)
    return (base.select(key, F.col(fit.label).cast("double").alias("actual"), fit.model.fitted().alias("fitted"),
                        fit.model.leverage().alias("leverage"))
            .withColumn("residual", F.col("actual") - F.col("fitted"))
            .withColumn("std_residual", F.col("residual") / (F.lit(fit.stats["sigma"]) * F.sqrt(1 - F.col("leverage")))))


def residual_qq(diag: DataFrame, n_points: int = 99) -> DataFrame:
    """Normal QQ data of the standardized residuals on a probability grid:
    (p, sample_quantile, normal_quantile).  The sample side takes exact
    quantiles of the whole column; the normal side is computed from the grid on
    the driver (n_points numbers)."""
    from statistics import NormalDist
    ps = [(i + 1) / (n_points + 1) for i in range(n_points)]
    normal = [NormalDist().inv_cdf(p) for p in ps]
    q = group_quantiles(diag.select(F.lit(0).alias("_all"), "std_residual"), ["_all"], "std_residual", ps)
    pts = F.arrays_zip(F.array(*[F.lit(p) for p in ps]).alias("p"), F.col("q").alias("sample_quantile"),
                       F.array(*[F.lit(z) for z in normal]).alias("normal_quantile"))
    return q.select(F.explode(pts).alias("r")).select("r.p", "r.sample_quantile", "r.normal_quantile")


# --- regression comparisons -----------------------------------------------------------

def _r2_rmse(pred: DataFrame, label: str = "_y", col: str = "prediction") -> dict:
    r = E.r2_rmse(pred, label, col).first()
    return {"n": r["n"], "r2": r["r2"], "rmse": r["rmse"]}


def linreg_compare(train: DataFrame, test: DataFrame, label: str, models: dict[str, list[str]],
                   train_cap: float | None = 50.0) -> DataFrame:
    """Fit one linear model per predictor list; report train/test R^2 and test
    RMSE, each model scored on its own predictions.  ``train_cap``: training
    rows with label above it are left out (the test set is not capped)."""
    rows = []
    used = sorted({c for cols in models.values() for c in cols})
    y = F.col(label).cast("double").alias("_y")
    tr = cut_lineage((train.where(F.col(label) <= train_cap) if train_cap is not None else train).select(y, *used))
    te = cut_lineage(test.select(y, *used))
    for name, cols in models.items():
        m = least_squares(tr, "_y", cols)
        a, b = (_r2_rmse(d.dropna(subset=["_y", *cols]).select("_y", m.fitted().alias("prediction"))) for d in (tr, te))
        rows.append((name, len(cols), a["n"], b["n"], a["r2"], b["r2"], b["rmse"]))
    return train.sparkSession.createDataFrame(
        rows, "model string, n_predictors int, n_train long, n_test long, r2_train double, r2_test double, "
              "rmse_test double")


RF_DEPTHS = list(range(1, 11)) + list(range(12, 31, 2))


def rf_sweep(train: DataFrame, test: DataFrame, label: str, cols: list[str], depths: list[int] = RF_DEPTHS,
             trees: list[int] = (20,), train_cap: float | None = 50.0) -> DataFrame:
    """Random-forest regressor over a (trees x depth) grid: train/test R^2 and RMSE.

    All features are considered at each split, so one forest, of the largest size
    and depth, holds every grid point: a shallower tree is the deeper one cut off,
    a smaller forest the first trees.  Train and test are scored once, at all points.
    """
    tr_base = train.where(F.col(label) <= train_cap) if train_cap is not None else train
    tr = cut_lineage(assemble(tr_base.withColumn("_y", F.col(label).cast("double")), cols, keep=["_y"]))
    te = cut_lineage(assemble(test.withColumn("_y", F.col(label).cast("double")), cols, keep=["_y"]))
    depths, trees = list(depths), list(trees)
    # each pass sends its trees as grown so far to find the rows' nodes, unless the nodes are kept beside the rows
    model = RandomForestRegressor(labelCol="_y", numTrees=max(trees), maxDepth=max(depths), featureSubsetStrategy="all",
                                  seed=SEED, maxMemoryInMB=SWEEP_MEMORY_MB, cacheNodeIds=max(depths) > DEEP).fit(tr)
    forest = sent_trees(forest_table(model))
    del model
    points = len(trees) * len(depths)
    a, b = (staged_scores(staged_predictions(d, forest, depths, trees, ["_y"]), "_y", points) for d in (tr, te))
    rows = [(t, d, x[0], z[0], x[1], z[1]) for (t, d), x, z in zip([(t, d) for t in trees for d in depths], a, b)]
    return train.sparkSession.createDataFrame(
        rows, "num_trees int, max_depth int, r2_train double, r2_test double, rmse_train double, rmse_test double")


def named_importances(spark: SparkSession, importances, names: list[str]) -> DataFrame:
    """(feature, importance) with one row per slot of the feature vector, largest first."""
    values = [float(v) for v in importances.toArray()]
    if len(values) != len(names):
        raise ValueError(f"{len(values)} importances for {len(names)} feature names")
    rows = sorted(zip(names, values), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, importance double")


def rf_importances(train: DataFrame, label: str, cols: list[str], names: list[str], trees: int = 40, depth: int = 10,
                   train_cap: float | None = 50.0) -> DataFrame:
    """Feature importances of a random-forest regressor; ``names`` has one name per vector slot."""
    tr_base = train.where(F.col(label) <= train_cap) if train_cap is not None else train
    tr = cut_lineage(assemble(tr_base.withColumn("_y", F.col(label).cast("double")), cols, keep=["_y"]))
    m = RandomForestRegressor(labelCol="_y", numTrees=trees, maxDepth=depth, featureSubsetStrategy="all",
                              seed=SEED, maxMemoryInMB=TREE_MEMORY_MB, cacheNodeIds=True).fit(tr)
    return named_importances(train.sparkSession, m.featureImportances, names)


# --- classifiers ---------------------------------------------------------------------

def logistic(train: DataFrame, c: float = 1.0):
    """Logistic regression with the library-style inverse strength C: sklearn
    minimises 1/2|w|^2 + C sum(loss); MLlib minimises mean(loss) + lambda/2 |w|^2,
    so lambda = 1 / (C n)."""
    n = train.count()
    return LogisticRegression(labelCol="label", regParam=1.0 / (c * n), elasticNetParam=0.0,
                              standardization=False, maxIter=500, tol=1e-10)


def logistic_certificate(model, rows: DataFrame, predictors: list[str], c: float = 1.0) -> DataFrame:
    """(predictor, coefficient, gradient): the derivative of the penalised loss
    mean(loss) + |w|^2 / (2 C n) at the fitted model, by one aggregate over ``rows``
    (label, features).  All near 0 proves the fit: the loss is convex.  The
    intercept carries no penalty."""
    x = vector_to_array("features")
    w = [float(v) for v in model.coefficients]
    margin = F.lit(float(model.intercept)) + sum((F.lit(v) * F.col("_x")[j] for j, v in enumerate(w)), F.lit(0.0))
    data = rows.select(x.alias("_x"), F.col("label").cast("double").alias("_y"))
    off = data.select("_x", (1 / (1 + F.exp(-margin)) - F.col("_y")).alias("_off"))
    sums = off.agg(F.count(F.lit(1)), F.avg("_off"), *[F.avg(F.col("_off") * F.col("_x")[j]) for j in range(len(w))]).first()
    n, at_intercept, *at = sums
    found = [(INTERCEPT, float(model.intercept), at_intercept)]
    found += [(p, v, g + v / (c * n)) for p, v, g in zip(predictors, w, at)]
    return rows.sparkSession.createDataFrame(found, "predictor string, coefficient double, gradient double")


TREE_MEMORY_MB = 1024  # node-statistics buffer per pass: more nodes split per data pass
SWEEP_MEMORY_MB = 128
DEEP = 10  # a tree of more levels may have about as many nodes as rows


def random_forest(trees: int = 100, depth: int = 30):
    return RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=depth,
                                  featureSubsetStrategy="sqrt", seed=SEED,
                                  maxMemoryInMB=TREE_MEMORY_MB, cacheNodeIds=True)


def _with_features(df: DataFrame, cols: list[str], label: str, key: str) -> DataFrame:
    return assemble(df.withColumn("label", F.col(label).cast("double")), cols, keep=[key, "label"])


def fit_classifier(train: DataFrame, cols: list[str], label: str, estimator: str, key: str = "Rww_ID", **params):
    """The fitted model alone; nothing is scored.  ``train`` is read several times: callers pass a checkpointed one."""
    tr = _with_features(train, cols, label, key).persist()
    try:
        if estimator == "logistic":
            est = logistic(tr, params.get("c", 1.0))
        elif estimator == "rf":
            est = random_forest(params.get("trees", 100), params.get("depth", 30))
        elif estimator == "gnb":
            est = NaiveBayes(labelCol="label", modelType="gaussian")
        else:
            raise ValueError(estimator)
        return est.fit(tr)
    finally:
        tr.unpersist()


def classify(train: DataFrame, scored: dict[str, DataFrame], cols: list[str], label: str, estimator: str,
             key: str = "Rww_ID", **params) -> dict[str, DataFrame]:
    """Fit on ``train``; return {name: (key, label, prediction, probability)} per scored frame.

    The frames are read several times: callers pass checkpointed ones.  A forest is written
    as a table and scores all frames from there."""
    model = fit_classifier(train, cols, label, estimator, key, **params)
    if estimator == "rf":
        voters = sent_voters(forest_table(model))
        # the class with the most votes, the smaller one of equals
        flag = F.array_position("votes", F.array_max("votes")) - 1
        prob = F.coalesce(F.get("votes", F.lit(1)), F.lit(0.0)) / F.aggregate("votes", F.lit(0.0), lambda a, v: a + v)
        predict = lambda feats: class_votes(feats, voters, [key, "label"])
    else:
        flag, prob = F.col("prediction"), vector_to_array("probability")[1]
        predict = model.transform
    out = {}
    for name, df in {"train": train, **scored}.items():
        out[name] = (predict(_with_features(df, cols, label, key))
                     .select(key, F.col("label").cast("int").alias(label),
                             flag.cast("int").alias("predicted_late_flag"), prob.alias("prob_late")))
    out["_model"] = model
    return out


def hard_label_scores(tn: int, fp: int, fn: int, tp: int) -> tuple[float | None, float | None, float | None]:
    """Accuracy, average precision and ROC AUC of 0/1 predictions from the
    confusion cells alone (the predictions take at most two score values):
    AP = R1 * P1 + (1 - R1) * prevalence when anything is predicted late, else
    the prevalence; AUC = (TPR + TNR) / 2 (ties count one half)."""
    n, pos, neg = tn + fp + fn + tp, tp + fn, tn + fp
    acc = (tp + tn) / n if n else None
    if pos == 0:
        return acc, None, None
    prevalence = pos / n
    if tp + fp:
        r1, p1 = tp / pos, tp / (tp + fp)
        ap = r1 * p1 + (1 - r1) * prevalence
    else:
        ap = prevalence
    auc = (tp / pos + tn / neg) / 2 if neg else None
    return acc, ap, auc


def classifier_report(preds: dict[str, DataFrame], label: str) -> DataFrame:
    """Report per scored set: accuracy, confusion cells, average precision and
    ROC AUC of the hard predictions (as the analysed scripts score them).
    One aggregate job per set: with 0/1 predictions every score follows from
    the four confusion cells."""
    spark: SparkSession | None = None
    rows = []
    for name, p in preds.items():
        if name.startswith("_"):
            continue
        spark = p.sparkSession
        cm = {(r[0], r[1]): r[2] for r in E.confusion_matrix(p, label, "predicted_late_flag").collect()}
        tn, fp, fn, tp = (cm.get(c, 0) for c in [(0, 0), (0, 1), (1, 0), (1, 1)])
        acc, ap, auc = hard_label_scores(tn, fp, fn, tp)
        rows.append((name, tn + fp + fn + tp, acc, tn, fp, fn, tp, ap, auc))
    return spark.createDataFrame(rows, "dataset string, n long, accuracy double, tn long, fp long, fn long, "
                                       "tp long, average_precision double, roc_auc double")


def gnb_params(model, cols: list[str]) -> list[tuple]:
    """(class, feature, log_prior, theta, sigma) rows of a fitted Gaussian NB."""
    pi = model.pi.toArray()
    theta, sigma = model.theta.toArray(), model.sigma.toArray()
    return [(int(k), cols[j], float(pi[k]), float(theta[k, j]), float(sigma[k, j]))
            for k in range(len(pi)) for j in range(len(cols))]
