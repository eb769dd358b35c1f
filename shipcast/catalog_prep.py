"""Registered sampling, preparation and evaluation queries (blueprint steps 6-7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import oracle as O
from .catalog import r9, register
from .operators import evaluate as E
from .operators import sampling as S
from .plans import datasets as ds
from .plans import variables as V

US_SEED = 7
_SCALED = [c for c in V.CLF_BASIC if c not in V.CLF_NOT_SCALED]


# --- SQL fragments -----------------------------------------------------------------

def _imputed(src: str) -> str:
    rep = ", ".join(f"coalesce(CAST(t.{c} AS DOUBLE), m._m_{c}) AS {c}" for c in V.CLF_BASIC)
    return f"SELECT t.* REPLACE ({rep}) FROM {src} t, imp_m m"


def _scaled(src: str) -> str:
    rep = ", ".join(f"CASE WHEN m._s_{c} = 0 THEN 0.0 ELSE (t.{c} - m._m_{c}) / m._s_{c} END AS {c}"
                    for c in _SCALED)
    return f"SELECT t.* REPLACE ({rep}) FROM {src} t, sc_m m"


_OUT = f"{V.SHIP_MISS_TRIM} <= shipping_limit_miss_amt AND distance_km < {V.DISTANCE_MAX_KM}"
_PREP = f"""
imp_m AS (SELECT {', '.join(f'avg(CAST({c} AS DOUBLE)) AS _m_{c}' for c in V.CLF_BASIC)} FROM clf_train),
clf_train_i AS ({_imputed('clf_train')}),
clf_test_i AS ({_imputed('clf_test')}),
clf_train_o AS (SELECT * FROM clf_train_i WHERE {_OUT}),
clf_test_o AS (SELECT * FROM clf_test_i WHERE {_OUT}),
sc_m AS (SELECT {', '.join(f'avg({c}) AS _m_{c}, stddev_samp({c}) AS _s_{c}' for c in _SCALED)} FROM clf_train_o),
clf_train_s AS ({_scaled('clf_train_o')}),
clf_test_s AS ({_scaled('clf_test_o')})"""

_US = f"""
us_min AS (
  SELECT Rww_ID, late_delivery_flag, row_number() OVER (ORDER BY {S.key_hash_sql('Rww_ID', US_SEED)}, Rww_ID) AS rn,
         count(*) OVER () AS n
  FROM clf_train WHERE late_delivery_flag = 1
),
us_n AS (SELECT max(n) AS n_min, ceil(0.25 * max(n)) AS n_test FROM us_min),
us_maj AS (
  SELECT Rww_ID, late_delivery_flag, row_number() OVER (ORDER BY {S.key_hash_sql('Rww_ID', US_SEED + 1)}, Rww_ID) AS rn
  FROM clf_train WHERE late_delivery_flag = 0
),
us AS (
  SELECT m.Rww_ID, m.late_delivery_flag, CASE WHEN m.rn <= c.n_test THEN 'test' ELSE 'train' END AS sample_part
  FROM us_min m, us_n c
  UNION ALL
  SELECT j.Rww_ID, j.late_delivery_flag, CASE WHEN j.rn <= c.n_min - c.n_test THEN 'train' ELSE 'test' END
  FROM us_maj j, us_n c WHERE j.rn <= c.n_min
)"""


def _undersampled(spark, sf):
    train, _ = ds.clf_split(spark, sf, [V.CLF_TARGET])
    return train, S.undersample_balanced(train.select("Rww_ID", V.CLF_TARGET), V.CLF_TARGET, "Rww_ID",
                                         seed=US_SEED)


# --- sampling -----------------------------------------------------------------------

@register("hash_split", O.on_features("SELECT Rww_ID, is_test FROM clf"))
def q_hash_split(spark, sf):
    """Exact 75/25 split by key hash: test = the ceil(0.25 n) smallest hashes."""
    return S.hash_split(ds.clf_frame(spark, sf).select("Rww_ID"), "Rww_ID", 0.25, seed=42)


@register("undersample_balanced", O.on_features("SELECT * FROM us", _US))
def q_undersample(spark, sf):
    _, us = _undersampled(spark, sf)
    return us


@register("holdout_antijoin", O.on_features(
    "SELECT Rww_ID, late_delivery_flag FROM clf_train t "
    "WHERE NOT EXISTS (SELECT 1 FROM us WHERE us.sample_part = 'train' AND us.Rww_ID = t.Rww_ID)", _US))
def q_holdout(spark, sf):
    """Validation rows: training rows not in the undersampled training part."""
    train, us = _undersampled(spark, sf)
    return (train.select("Rww_ID", V.CLF_TARGET)
            .join(us.where(F.col("sample_part") == "train").select("Rww_ID"), "Rww_ID", "left_anti"))


@register("union_samples", O.on_features(
    "SELECT sample_part, late_delivery_flag, count(*) AS n FROM us GROUP BY 1, 2", _US))
def q_union_samples(spark, sf):
    _, us = _undersampled(spark, sf)
    return us.groupBy("sample_part", V.CLF_TARGET).agg(F.count(F.lit(1)).alias("n"))


# --- preparation --------------------------------------------------------------------

@register("impute_mean", O.on_features(
    "SELECT Rww_ID, 'train' AS part, " + ", ".join(f"round({c}, 9) AS {c}" for c in V.CLF_BASIC)
    + " FROM clf_train_i UNION ALL SELECT Rww_ID, 'test', "
    + ", ".join(f"round({c}, 9)" for c in V.CLF_BASIC) + " FROM clf_test_i", _PREP))
def q_impute(spark, sf):
    tr, te, *_ = ds.clf_prepared(spark, sf)
    cols = [r9(c) for c in V.CLF_BASIC]
    return (tr.select("Rww_ID", F.lit("train").alias("part"), *cols)
            .unionByName(te.select("Rww_ID", F.lit("test").alias("part"), *cols)))


@register("drop_outliers", O.on_features(
    "SELECT Rww_ID, 'train' AS part FROM clf_train_o UNION ALL SELECT Rww_ID, 'test' FROM clf_test_o", _PREP))
def q_drop_outliers(spark, sf):
    _, _, tr, te, _, _ = ds.clf_prepared(spark, sf)
    return (tr.select("Rww_ID", F.lit("train").alias("part"))
            .unionByName(te.select("Rww_ID", F.lit("test").alias("part"))))


@register("semi_align", O.on_features(" UNION ALL ".join(
    f"SELECT Rww_ID, '{part}' AS part, late_delivery_flag FROM clf_{part} t "
    f"WHERE EXISTS (SELECT 1 FROM clf_{part}_o o WHERE o.Rww_ID = t.Rww_ID)" for part in ("train", "test")), _PREP))
def q_semi_align(spark, sf):
    """Labels of the training and test rows that survive the outlier rules (semi join)."""
    train, test = ds.clf_split(spark, sf, [V.CLF_TARGET, *V.CLF_BASIC, *ds.OUTLIER_COLS])
    _, _, tr, te, _, _ = ds.clf_prepared(spark, sf, parts=(train, test))
    out = [d.select("Rww_ID", F.lit(part).alias("part"), V.CLF_TARGET).join(o.select("Rww_ID"), "Rww_ID", "left_semi")
           for part, d, o in (("train", train, tr), ("test", test, te))]
    return out[0].unionByName(out[1])


@register("standardize", O.on_features(
    "SELECT Rww_ID, 'train' AS part, " + ", ".join(f"round({c}, 9) AS {c}" for c in _SCALED)
    + " FROM clf_train_s UNION ALL SELECT Rww_ID, 'test', "
    + ", ".join(f"round({c}, 9)" for c in _SCALED) + " FROM clf_test_s", _PREP))
def q_standardize(spark, sf):
    *_, tr, te = ds.clf_prepared(spark, sf)
    cols = [r9(c) for c in _SCALED]
    return (tr.select("Rww_ID", F.lit("train").alias("part"), *cols)
            .unionByName(te.select("Rww_ID", F.lit("test").alias("part"), *cols)))


# --- evaluation on a rule predictor (SQL-checkable) -------------------------------
# predicted late = the shipping limit was missed; score = days the limit was missed by

_RULE_PRED, _RULE_SCORE = "shipping_limit_missed", "shipping_limit_miss_amt"


def _test(spark, sf):
    _, test = ds.clf_split(spark, sf, [V.CLF_TARGET, _RULE_PRED, _RULE_SCORE])
    return test


@register("confusion_matrix", O.on_features(
    f"SELECT late_delivery_flag AS actual_late_flag, {_RULE_PRED} AS predicted_late_flag, count(*) AS cnt "
    "FROM clf_test GROUP BY 1, 2"))
def q_confusion(spark, sf):
    return E.confusion_matrix(_test(spark, sf), V.CLF_TARGET, _RULE_PRED)


@register("accuracy", O.on_features(
    f"SELECT count(*) AS n, round(avg(CAST(late_delivery_flag = {_RULE_PRED} AS DOUBLE)), 9) AS accuracy FROM clf_test"))
def q_accuracy(spark, sf):
    return E.accuracy(_test(spark, sf), V.CLF_TARGET, _RULE_PRED).select("n", r9("accuracy"))


_SCORES = f"""
sc AS (SELECT CAST({{score}} AS DOUBLE) AS score, sum(CAST(late_delivery_flag AS BIGINT)) AS tp,
              sum(1 - CAST(late_delivery_flag AS BIGINT)) AS fp
       FROM clf_test WHERE {{score}} IS NOT NULL GROUP BY 1),
run AS (SELECT *, sum(tp) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_tp,
               sum(fp) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_fp,
               sum(tp) OVER () AS P, sum(fp) OVER () AS N FROM sc)"""


@register("pr_curve", O.on_features("""
SELECT score AS threshold, round(CAST(cum_tp AS DOUBLE) / (cum_tp + cum_fp), 9) AS precision,
       round(CAST(cum_tp AS DOUBLE) / P, 9) AS recall
FROM run UNION ALL SELECT NULL, 1.0, 0.0""", _SCORES.format(score=_RULE_PRED)))
def q_pr_curve(spark, sf):
    c = E.pr_curve(_test(spark, sf), V.CLF_TARGET, _RULE_PRED)
    return c.select("threshold", r9("precision"), r9("recall"))


@register("average_precision", O.on_features(
    "SELECT round(sum(CAST(tp AS DOUBLE) / P * cum_tp / (cum_tp + cum_fp)), 9) AS average_precision FROM run",
    _SCORES.format(score=_RULE_PRED)))
def q_average_precision(spark, sf):
    return E.average_precision(_test(spark, sf), V.CLF_TARGET, _RULE_PRED).select(r9("average_precision"))


@register("roc_curve", O.on_features("""
SELECT score AS threshold, round(CAST(cum_fp AS DOUBLE) / N, 9) AS fpr, round(CAST(cum_tp AS DOUBLE) / P, 9) AS tpr
FROM run UNION ALL SELECT NULL, 0.0, 0.0""", _SCORES.format(score=_RULE_SCORE)))
def q_roc_curve(spark, sf):
    c = E.roc_curve(_test(spark, sf), V.CLF_TARGET, _RULE_SCORE)
    return c.select("threshold", r9("fpr"), r9("tpr"))


@register("roc_auc", O.on_features(
    "SELECT round(sum(tp * (N - cum_fp + fp / 2.0)) / (max(P) * max(N)), 9) AS roc_auc FROM run",
    _SCORES.format(score=_RULE_SCORE)))
def q_roc_auc(spark, sf):
    return E.roc_auc(_test(spark, sf), V.CLF_TARGET, _RULE_SCORE).select(r9("roc_auc"))


@register("r2_rmse", O.on_features("""
SELECT count(*) AS n, round(1 - sum(power(fulfill_duration - est_delivery_time_days, 2)) / (var_pop(fulfill_duration) * count(*)), 9) AS r2,
       round(avg(power(fulfill_duration - est_delivery_time_days, 2)), 9) AS mse,
       round(sqrt(avg(power(fulfill_duration - est_delivery_time_days, 2))), 9) AS rmse
FROM reg_test"""))
def q_r2_rmse(spark, sf):
    """R^2 / MSE / RMSE of the promised estimate used as the prediction."""
    _, test = ds.reg_split(spark, sf, [V.REG_TARGET, "est_delivery_time_days"])
    m = E.r2_rmse(test, V.REG_TARGET, "est_delivery_time_days")
    return m.select("n", r9("r2"), r9("mse"), r9("rmse"))


@register("baseline_rmse", O.on_features(
    "SELECT round(sqrt(avg(power(fulfill_duration - est_delivery_time_days, 2))), 9) AS rmse FROM reg_test"))
def q_baseline_rmse(spark, sf):
    _, test = ds.reg_split(spark, sf, [V.REG_TARGET, "est_delivery_time_days"])
    err = F.col(V.REG_TARGET) - F.col("est_delivery_time_days")
    return test.agg(F.sqrt(F.avg(err * err)).alias("rmse")).select(r9("rmse"))
