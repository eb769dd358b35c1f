"""Registered model queries (blueprint step 8).

Closed-form models (two-predictor OLS, one-predictor regression, Gaussian
naive Bayes) also get oracle SQL; tree ensembles and iterative fits are
rows-only (their results depend on the library's randomisation / solver).
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from . import oracle as O
from .catalog import FLAG_STATES, r6, r9, register, round6
from .catalog_levels import _LO, MIN_HIGH, MIN_LOW, MIN_MOVER
from .catalog_prep import _PREP, _SCALED
from .functions import geo
from .operators import levels as L
from .operators import sampling as S
from .plans import datasets as ds
from .plans import models as M
from .plans import variables as V
from .session import cut_lineage, stored_table

OLS_X = ["distance_km", "review_score"]


def _ols_sql(y: str, log: bool = False) -> str:
    yy = f"ln({y})" if log else y
    cond = f"{y} IS NOT NULL AND distance_km IS NOT NULL AND review_score IS NOT NULL" + (f" AND {y} > 0" if log else "")
    return f"""
ob AS (SELECT count(*) AS n, avg(distance_km) AS m1, avg(review_score) AS m2, avg({yy}) AS my,
              var_samp(distance_km) AS s11, var_samp(review_score) AS s22, covar_samp(distance_km, review_score) AS s12,
              covar_samp(distance_km, {yy}) AS c1, covar_samp(review_score, {yy}) AS c2, var_samp({yy}) AS syy
       FROM ci WHERE {cond}),
oc AS (SELECT *, s11 * s22 - s12 * s12 AS det FROM ob),
od AS (SELECT *, (c1 * s22 - c2 * s12) / det AS b1, (c2 * s11 - c1 * s12) / det AS b2 FROM oc),
oe2 AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, (n - 1) * (syy - (b1 * c1 + b2 * c2)) AS sse FROM od),
of2 AS (SELECT *, sse / (n - 3) AS s2, 1 - sse / ((n - 1) * syy) AS r2 FROM oe2),
og AS (SELECT *, sqrt(s2 * s22 / det / (n - 1)) AS se1, sqrt(s2 * s11 / det / (n - 1)) AS se2,
              sqrt(s2 * (1.0 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / det / (n - 1))) AS se0
       FROM of2)"""


_OLS_SELECT = """
SELECT term, round(estimate, 6) AS estimate, round(std_error, 6) AS std_error, round(t_value, 6) AS t_value,
       n, round(r2, 9) AS r2, round(r2adj, 9) AS r2adj, round(f_stat, 6) AS f_stat
FROM (
  SELECT 'distance_km' AS term, b1 AS estimate, se1 AS std_error, b1 / se1 AS t_value, n, r2,
         1 - (1 - r2) * (n - 1) / (n - 3) AS r2adj, (r2 / 2) / ((1 - r2) / (n - 3)) AS f_stat FROM og
  UNION ALL SELECT 'review_score', b2, se2, b2 / se2, n, r2, 1 - (1 - r2) * (n - 1) / (n - 3),
         (r2 / 2) / ((1 - r2) / (n - 3)) FROM og
  UNION ALL SELECT '(Intercept)', b0, se0, b0 / se0, n, r2, 1 - (1 - r2) * (n - 1) / (n - 3),
         (r2 / 2) / ((1 - r2) / (n - 3)) FROM og)"""


def _ols_query(spark, sf, label: str, log: bool = False):
    fit = M.ols(ds.clean_items(spark, sf), label, OLS_X, log_label=log)
    t = M.ols_table(fit)
    return t.select("term", r6("estimate"), r6("std_error"), r6("t_value"), "n",
                    r9("r2"), r9("r2adj"), r6("f_stat"))


@register("ols_duration", O.on_items(_OLS_SELECT, _ols_sql("delivery_hours")))
def q_ols_duration(spark, sf):
    """Delivery hours ~ distance + review score (OLS with R-style summary)."""
    return _ols_query(spark, sf, "delivery_hours")


@register("ols_log_duration", O.on_items(_OLS_SELECT, _ols_sql("delivery_hours", log=True)))
def q_ols_log_duration(spark, sf):
    return _ols_query(spark, sf, "delivery_hours", log=True)


@register("ols_carrier_leg", O.on_items(_OLS_SELECT, _ols_sql("carrier_to_customer_hours")))
def q_ols_carrier_leg(spark, sf):
    return _ols_query(spark, sf, "carrier_to_customer_hours")


_RESIDUALS = _ols_sql("delivery_hours") + """,
resid0 AS (
  SELECT CAST(c.order_id AS BIGINT) * 1048576 + c.order_item_id AS Rww_ID, c.delivery_hours AS actual,
         g.b0 + g.b1 * c.distance_km + g.b2 * c.review_score AS fitted, g.s2,
         1.0 / g.n + (power(c.distance_km - g.m1, 2) * g.s22 - 2 * (c.distance_km - g.m1) * (c.review_score - g.m2) * g.s12
                      + power(c.review_score - g.m2, 2) * g.s11) / (g.det * (g.n - 1)) AS leverage
  FROM ci c, og g
  WHERE c.delivery_hours IS NOT NULL AND c.distance_km IS NOT NULL AND c.review_score IS NOT NULL
),
resid AS (SELECT *, actual - fitted AS residual, (actual - fitted) / (sqrt(s2) * sqrt(1 - leverage)) AS std_residual FROM resid0)"""


def _ols_items(spark, sf):
    """The clean items' columns of the OLS, stored: the fit and its residuals read them."""
    return stored_table(ds.clean_items(spark, sf).select("Rww_ID", "delivery_hours", *OLS_X), "ols-items")


@register("residual_diagnostics", O.on_items(
    "SELECT Rww_ID, actual, round(fitted, 6) AS fitted, round(leverage, 9) AS leverage, round(residual, 6) AS residual, "
    "round(std_residual, 6) AS std_residual FROM resid", _RESIDUALS))
def q_residuals(spark, sf):
    """Fitted values, residuals, leverage and standardized residuals of the OLS."""
    items = _ols_items(spark, sf)
    fit = M.ols(items, "delivery_hours", OLS_X)
    d = M.residual_diagnostics(items, fit, "Rww_ID")
    return d.select("Rww_ID", "actual", r6("fitted"), r9("leverage"), r6("residual"), r6("std_residual"))


QQ_PS = [(i + 1) / 100 for i in range(99)]


@register("residual_qq", O.on_items(
    "SELECT p, round(v, 6) AS sample_quantile FROM rq",
    _RESIDUALS, "\nrqv AS (SELECT 0 AS g, std_residual FROM resid)", O.quantiles_cte("rq", "rqv", ["g"], "std_residual", QQ_PS)))
def q_residual_qq(spark, sf):
    """Sample side of the normal QQ points of the OLS standardized residuals (the
    normal side is a function of p alone)."""
    items = _ols_items(spark, sf)
    fit = M.ols(items, "delivery_hours", OLS_X)
    qq = M.residual_qq(M.residual_diagnostics(items, fit, "Rww_ID"), len(QQ_PS))
    return qq.select("p", r6("sample_quantile"))


# --- regression models ---------------------------------------------------------------

REG_CAP = 50.0


@register("linreg_est_only", O.on_features(f"""
SELECT round(b0, 6) AS intercept, round(b1, 6) AS slope,
       round(1 - (SELECT sum(power(fulfill_duration - (b0 + b1 * est_delivery_time_days), 2)) FROM reg_train WHERE fulfill_duration <= {REG_CAP})
             / (SELECT var_pop(fulfill_duration) * count(*) FROM reg_train WHERE fulfill_duration <= {REG_CAP}), 6) AS r2_train,
       round(1 - (SELECT sum(power(fulfill_duration - (b0 + b1 * est_delivery_time_days), 2)) FROM reg_test)
             / (SELECT var_pop(fulfill_duration) * count(*) FROM reg_test), 6) AS r2_test,
       round((SELECT sqrt(avg(power(fulfill_duration - (b0 + b1 * est_delivery_time_days), 2))) FROM reg_test), 6) AS rmse_test
FROM (SELECT b1, my - b1 * mx AS b0 FROM (
  SELECT covar_samp(est_delivery_time_days, fulfill_duration) / var_samp(est_delivery_time_days) AS b1,
         avg(fulfill_duration) AS my, avg(est_delivery_time_days) AS mx
  FROM reg_train WHERE fulfill_duration <= {REG_CAP}))"""))
def q_linreg_est_only(spark, sf):
    """Promised-estimate-only linear model: coefficients, train/test R^2, test RMSE."""
    from .operators import evaluate as E
    from .plans.leastsquares import least_squares
    y = F.col(V.REG_TARGET).alias("_y")
    train, test = (d.select(y, *V.REG_ESTIMATE_ONLY) for d in ds.reg_split(spark, sf, [V.REG_TARGET, *V.REG_ESTIMATE_ONLY]))
    tr, te = cut_lineage(train.where(F.col("_y") <= REG_CAP)), cut_lineage(test)
    m = least_squares(tr, "_y", V.REG_ESTIMATE_ONLY)
    tr, te = (d.withColumn("prediction", m.fitted()) for d in (tr, te))
    a = E.r2_rmse(tr, "_y", "prediction").select(F.col("r2").alias("r2_train"))
    b = E.r2_rmse(te, "_y", "prediction").select(F.col("r2").alias("r2_test"), "rmse")
    coef = spark.createDataFrame([(m.intercept, m.coefficients[0])], "intercept double, slope double")
    return (coef.crossJoin(a).crossJoin(b)
            .select(r6("intercept"), r6("slope"), r6("r2_train"), r6("r2_test"), r6("rmse", "rmse_test")))


_MODEL2_COLS = ["lat_customer", "ttl_freight", "long_customer", "est_delivery_mo"]


def _reg_frames(spark, sf):
    train, test = ds.reg_split(spark, sf, [V.REG_TARGET, *V.REG_PREDICTORS, *_MODEL2_COLS, "customer_state"])
    flags = [geo.state_flag("customer_state", s).alias(f"Cust_st_{s}") for s in FLAG_STATES]
    return train.select("*", *flags), test.select("*", *flags)


REG_MODEL2 = [f"Cust_st_{s}" for s in FLAG_STATES] + _MODEL2_COLS


@register("linreg_compare")
def q_linreg_compare(spark, sf):
    """Three linear models (19 predictors; geo/freight/month; estimate only)."""
    train, test = _reg_frames(spark, sf)
    return M.linreg_compare(train, test, V.REG_TARGET, {
        "continuous_19": V.REG_PREDICTORS, "geo_freight_month": REG_MODEL2, "estimate_only": V.REG_ESTIMATE_ONLY},
        train_cap=REG_CAP)


@register("rf_depth_sweep")
def q_rf_depth_sweep(spark, sf):
    """Random-forest regressor, 20 trees, depth 1-10 then 12-30 step 2, from one fit to depth 30."""
    train, test = ds.reg_split(spark, sf, [V.REG_TARGET, *V.REG_PREDICTORS])
    return M.rf_sweep(train, test, V.REG_TARGET, V.REG_PREDICTORS, trees=[20], train_cap=REG_CAP)


def _reg_with_dummies(spark, sf, test: bool = True):
    """Regression frames with the grouped high-cardinality columns one-hot
    encoded as sparse vectors (training levels; unseen test levels are zeros),
    their predictor columns, and a name per slot of the assembled vector.
    Without ``test`` the test rows are not prepared: None stands for them."""
    train, held_out = ds.reg_split(spark, sf, [V.REG_TARGET, *V.REG_PREDICTORS, *V.REG_HICARD])
    stats = L.level_stats(train, V.REG_HICARD, V.REG_TARGET)
    movers = L.big_movers(stats, train, V.REG_TARGET, MIN_MOVER)
    grouped = [cut_lineage(L.group_rare_levels(d, movers, V.REG_HICARD).drop(*V.REG_HICARD))
               for d in ([train, held_out] if test else [train])]
    levels = L.long_levels(grouped[0], [c + "__grpd" for c in V.REG_HICARD], [])
    (tr, *te), vec_cols, slots = M.encode_levels(grouped, levels)
    return tr, te[0] if test else None, V.REG_PREDICTORS + vec_cols, V.REG_PREDICTORS + slots


@register("rf_trees_sweep")
def q_rf_trees_sweep(spark, sf):
    """Random-forest regressor on continuous predictors + level dummies, depth 10, 20 to 200 trees."""
    tr, te, cols, _ = _reg_with_dummies(spark, sf)
    return M.rf_sweep(tr, te, V.REG_TARGET, cols, depths=[10], trees=list(range(20, 201, 20)), train_cap=REG_CAP)


@register("rf_importances")
def q_rf_importances(spark, sf):
    """Importances of the regressor, one row per predictor and level indicator."""
    tr, _, cols, names = _reg_with_dummies(spark, sf, test=False)
    return M.rf_importances(tr, V.REG_TARGET, cols, names, trees=40, depth=10, train_cap=REG_CAP)


# --- classifiers ---------------------------------------------------------------------

def _major_levels(train):
    """(variabl, ctgry_lvl) of the major-impact levels of the training rows."""
    odds = L.level_odds(train, V.CLF_CATEGORICAL, V.CLF_TARGET)
    return (L.impactful_levels(odds, train, V.CLF_TARGET, V.CLF_LOWCARD, V.CLF_HICARD, MIN_LOW, MIN_HIGH)
            .where(F.col("major_impact_flag") == 1).select("variabl", "ctgry_lvl"))


def _clf_frames(spark, sf, long: bool):
    """Prepared (and for ``long`` level-encoded) classifier frames, checkpointed
    once so sampling, fitting and scoring read them instead of re-running the
    fixture -> split -> preparation lineage; predictor columns; slot names."""
    *_, train, test = ds.clf_prepared(spark, sf, keep=V.CLF_CATEGORICAL if long else [])
    cols, names = list(V.CLF_BASIC), list(V.CLF_BASIC)
    if long:
        train, test = cut_lineage(train), cut_lineage(test)
        (train, test), vec_cols, slots = M.encode_levels([train, test], _major_levels(train))
        cols, names = cols + vec_cols, names + slots
    keep = ["Rww_ID", V.CLF_TARGET, *cols]
    return cut_lineage(train.select(*keep)), cut_lineage(test.select(*keep)), cols, names


def _clf_query(spark, sf, estimator: str, long: bool, **params):
    train, test, cols, _ = _clf_frames(spark, sf, long)
    preds = M.classify(train, {"test": test}, cols, V.CLF_TARGET, estimator, **params)
    del preds["_model"]  # a forest's objects would fill the driver while its table scores
    return M.classifier_report(preds, V.CLF_TARGET)


@register("logreg_basic")
def q_logreg_basic(spark, sf):
    return _clf_query(spark, sf, "logistic", long=False)


GRADIENT_LIMIT = 1e-4


@register("logreg_certificate", " UNION ALL ".join(
    f"SELECT '{p}' AS predictor, true AS at_optimum" for p in [M.INTERCEPT, *V.CLF_BASIC]))
def q_logreg_certificate(spark, sf):
    """Whether the gradient of the penalised loss is below 1e-4 for the intercept and
    each basic predictor at the fitted logistic regression."""
    train, _, cols, _ = _clf_frames(spark, sf, long=False)
    rows = M.assemble(train.withColumn("label", F.col(V.CLF_TARGET).cast("double")), cols, keep=["label"])
    found = M.logistic_certificate(M.logistic(rows).fit(rows), rows, cols)
    return found.select("predictor", (F.abs("gradient") < GRADIENT_LIMIT).alias("at_optimum"))


@register("logreg_long")
def q_logreg_long(spark, sf):
    return _clf_query(spark, sf, "logistic", long=True)


@register("rf_clf_basic")
def q_rf_clf_basic(spark, sf):
    return _clf_query(spark, sf, "rf", long=False)


@register("rf_clf_long")
def q_rf_clf_long(spark, sf):
    return _clf_query(spark, sf, "rf", long=True)


@register("rf_clf_importances")
def q_rf_clf_importances(spark, sf):
    """Importances of the long classifier's forest, one row per predictor and level indicator."""
    train, _, cols, names = _clf_frames(spark, sf, long=True)
    model = M.fit_classifier(train, cols, V.CLF_TARGET, "rf")
    return M.named_importances(spark, model.featureImportances, names)


@register("one_hot_vector_counts", O.on_features("""
SELECT l.variabl || '=' || l.ctgry_lvl AS slot, CAST(count(*) FILTER (WHERE l.part = 'train') AS BIGINT) AS ones_train,
       CAST(count(*) FILTER (WHERE l.part = 'test') AS BIGINT) AS ones_test
FROM vl l JOIN (SELECT DISTINCT variabl, ctgry_lvl FROM maj) m USING (variabl, ctgry_lvl) GROUP BY 1""",
    _LO + ",\nvboth AS (SELECT *, 'train' AS part FROM clf_train UNION ALL SELECT *, 'test' AS part FROM clf_test),"
    + O.long_levels_cte("vl", "vboth", V.CLF_LOWCARD + V.CLF_HICARD, ["part"])))
def q_one_hot_vector_counts(spark, sf):
    """Ones per indicator in train and test, read back from the encoded vectors."""
    train, test = (cut_lineage(d) for d in ds.clf_split(spark, sf, [V.CLF_TARGET, *V.CLF_CATEGORICAL]))
    (tr, te), cols, names = M.encode_levels([train, test], _major_levels(train))
    both = tr.select(F.lit("train").alias("part"), *cols).unionByName(te.select(F.lit("test").alias("part"), *cols))
    # counted in the sparse vectors: a row of counts per part, a count per slot
    counted = both.groupBy("part").agg(*[Summarizer.numNonZeros(F.col(c)).alias(c) for c in cols])
    ones = (counted.select("part", F.posexplode(F.concat(*[vector_to_array(c) for c in cols])).alias("slot", "n"))
            .where("n > 0"))
    slots = spark.createDataFrame(list(enumerate(names)), "slot int, name string")
    return (ones.join(slots, "slot").groupBy(F.col("name").alias("slot"))
            .agg(*[F.coalesce(F.sum(F.when(F.col("part") == p, F.col("n"))), F.lit(0.0)).cast("bigint").alias(f"ones_{p}")
                   for p in ("train", "test")]))


@register("rf_undersampled")
def q_rf_undersampled(spark, sf):
    """RF (100 trees) on the balanced sample; scored on its test part and on the
    training rows left out of the sample (validation)."""
    train, _, cols, _ = _clf_frames(spark, sf, long=True)
    us = S.undersample_balanced(train.select("Rww_ID", V.CLF_TARGET), V.CLF_TARGET, "Rww_ID", seed=7)
    part = us.select("Rww_ID", "sample_part")
    us_train = train.join(part.where("sample_part = 'train'").select("Rww_ID"), "Rww_ID", "left_semi")
    us_test = train.join(part.where("sample_part = 'test'").select("Rww_ID"), "Rww_ID", "left_semi")
    valid = train.join(part.where("sample_part = 'train'").select("Rww_ID"), "Rww_ID", "left_anti")
    preds = M.classify(us_train, {"test": us_test, "validation": valid}, cols, V.CLF_TARGET, "rf", trees=100)
    del preds["_model"]
    return M.classifier_report(preds, V.CLF_TARGET)


# --- Gaussian naive Bayes (closed form, SQL-checkable) -------------------------------

def _gnb(spark, sf, test: bool = False):
    """Naive Bayes on the prepared training rows; scored test rows where asked for."""
    *_, train, te = ds.clf_prepared(spark, sf)
    keep = ["Rww_ID", V.CLF_TARGET, *V.CLF_BASIC]
    scored = {"test": cut_lineage(te.select(*keep))} if test else {}
    return M.classify(cut_lineage(train.select(*keep)), scored, V.CLF_BASIC, V.CLF_TARGET, "gnb")


_GNB = _PREP + """,
gnb_eps AS (SELECT 1e-9 * greatest(""" + ", ".join(f"var_pop({c})" for c in V.CLF_BASIC) + """) AS eps FROM clf_train_s),
gnb_long AS (""" + "\n  UNION ALL ".join(
    f"SELECT late_delivery_flag AS k, '{c}' AS feature, {j} AS j, {c} AS x FROM clf_train_s"
    for j, c in enumerate(V.CLF_BASIC)) + """),
gnb_cls AS (SELECT late_delivery_flag AS k, ln(count(*) / (SELECT count(*) FROM clf_train_s)) AS log_prior
            FROM clf_train_s GROUP BY 1),
gnb AS (SELECT g.k, g.feature, g.j, c.log_prior, avg(g.x) AS theta, var_pop(g.x) + e.eps AS sigma
        FROM gnb_long g JOIN gnb_cls c USING (k), gnb_eps e GROUP BY g.k, g.feature, g.j, c.log_prior, e.eps)"""


@register("gnb_params", O.on_features(
    "SELECT CAST(k AS INTEGER) AS class, feature, round(log_prior, 9) AS log_prior, round(theta, 9) AS theta, "
    "round(sigma, 9) AS sigma FROM gnb", _GNB))
def q_gnb_params(spark, sf):
    """Gaussian naive Bayes on the scaled basic predictors: log priors, means, variances."""
    preds = _gnb(spark, sf)
    rows = M.gnb_params(preds["_model"], V.CLF_BASIC)
    df = spark.createDataFrame(rows, "class int, feature string, log_prior double, theta double, sigma double")
    return df.select("class", "feature", r9("log_prior"), r9("theta"), r9("sigma"))


@register("gnb_confusion", O.on_features("""
SELECT actual_late_flag, predicted_late_flag, count(*) AS cnt FROM (
  SELECT t.Rww_ID, any_value(t.late_delivery_flag) AS actual_late_flag,
         arg_max(g.k, g.ll) AS predicted_late_flag
  FROM (SELECT t.Rww_ID, g.k, any_value(g.log_prior) - 0.5 * sum(ln(2 * pi() * g.sigma))
               - 0.5 * sum(power(tl.x - g.theta, 2) / g.sigma) AS ll
        FROM clf_test_s t JOIN (""" + "\n  UNION ALL ".join(
    f"SELECT Rww_ID, {j} AS j, {c} AS x FROM clf_test_s" for j, c in enumerate(V.CLF_BASIC)) + """) tl
          ON t.Rww_ID = tl.Rww_ID
        JOIN gnb g ON g.j = tl.j
        GROUP BY t.Rww_ID, g.k) g
  JOIN clf_test_s t USING (Rww_ID)
  GROUP BY t.Rww_ID)
GROUP BY 1, 2""", _GNB))
def q_gnb_confusion(spark, sf):
    from .operators import evaluate as E
    preds = _gnb(spark, sf, test=True)
    return E.confusion_matrix(preds["test"], V.CLF_TARGET, "predicted_late_flag")


_GNB_TRAIN = _GNB + """,
gnb_ll AS (
  SELECT tl.Rww_ID, g.k, any_value(g.log_prior) - 0.5 * sum(ln(2 * pi() * g.sigma))
         - 0.5 * sum(power(tl.x - g.theta, 2) / g.sigma) AS ll
  FROM (""" + "\n  UNION ALL ".join(
    f"SELECT Rww_ID, {j} AS j, {c} AS x FROM clf_train_s" for j, c in enumerate(V.CLF_BASIC)) + """) tl
  JOIN gnb g ON g.j = tl.j GROUP BY tl.Rww_ID, g.k
),
gnb_prob AS (
  SELECT Rww_ID, any_value(t.late_delivery_flag) AS y,
         1 / (1 + exp(least(700, sum(CASE WHEN k = 0 THEN ll ELSE -ll END)))) AS prob
  FROM gnb_ll JOIN clf_train_s t USING (Rww_ID) GROUP BY Rww_ID
),
gnb_scores AS (
  SELECT floor(prob * 1e6 + 0.5) / 1e6 AS score, sum(y) AS tp, sum(1 - y) AS fp FROM gnb_prob GROUP BY 1
),
gnb_run AS (
  SELECT *, sum(tp) OVER w AS cum_tp, sum(fp) OVER w AS cum_fp, sum(tp) OVER () AS P, sum(fp) OVER () AS N
  FROM gnb_scores WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)
)"""


def _gnb_train_scores(spark, sf):
    """Naive-Bayes late probabilities of the training rows, to 6 decimals."""
    return _gnb(spark, sf)["train"].withColumn("prob_late", round6("prob_late"))


@register("score_distribution", O.on_features(
    "SELECT floor(score * 100 + 0.5) / 100 AS prob_late, CAST(sum(tp + fp) AS BIGINT) AS n FROM gnb_scores GROUP BY 1",
    _GNB_TRAIN))
def q_score_distribution(spark, sf):
    """How the naive-Bayes late probabilities are distributed (2-decimal bins)."""
    return (_gnb_train_scores(spark, sf).groupBy((F.floor(F.col("prob_late") * 100 + 0.5) / 100).alias("prob_late"))
            .agg(F.count(F.lit(1)).alias("n")))


@register("gnb_roc_curve", O.on_features("""
SELECT score AS threshold, round(CAST(cum_fp AS DOUBLE) / N, 9) AS fpr, round(CAST(cum_tp AS DOUBLE) / P, 9) AS tpr
FROM gnb_run UNION ALL SELECT NULL, 0.0, 0.0""", _GNB_TRAIN))
def q_gnb_roc_curve(spark, sf):
    """ROC points of the naive-Bayes training probabilities."""
    from .operators import evaluate as E
    return E.roc_curve(_gnb_train_scores(spark, sf), V.CLF_TARGET, "prob_late").select("threshold", r9("fpr"), r9("tpr"))


@register("gnb_roc_auc", O.on_features(
    "SELECT round(sum(tp * (N - cum_fp + fp / 2.0)) / any_value(CAST(P AS DOUBLE) * N), 9) AS roc_auc FROM gnb_run", _GNB_TRAIN))
def q_gnb_roc_auc(spark, sf):
    """Area under the ROC curve of the naive-Bayes training probabilities."""
    from .operators import evaluate as E
    return E.roc_auc(_gnb_train_scores(spark, sf), V.CLF_TARGET, "prob_late").select(r9("roc_auc"))


# --- stream scoring -----------------------------------------------------------------

def _gnb_confusion_sql() -> str:
    from .catalog import ORACLE
    return ORACLE["gnb_confusion"]


@register("stream_scoring", _gnb_confusion_sql())
def q_stream_scoring(spark, sf):
    """Test orders arrive as files; a Structured Streaming query (availableNow)
    imputes, applies the outlier rules, scales and scores them with the
    train-fitted naive-Bayes pipeline.  Reported as the confusion matrix of the
    streamed predictions (equal to the batch model's)."""
    from .operators import evaluate as E
    from .streaming.scoring import stream_predictions
    train, test = ds.clf_split(spark, sf, [V.CLF_TARGET, *V.CLF_BASIC])
    preds = stream_predictions(train, test, V.CLF_BASIC, V.CLF_NOT_SCALED, "Rww_ID", V.CLF_TARGET)
    return E.confusion_matrix(preds, V.CLF_TARGET, "predicted_late_flag")
