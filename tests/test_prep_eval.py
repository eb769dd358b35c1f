import numpy as np
import pytest
from pyspark.sql import functions as F

from shipcast.operators import evaluate as E
from shipcast.operators import prep


def test_impute_then_scale(spark):
    train = spark.createDataFrame([(1, 1.0, 5.0), (2, None, 5.0), (3, 3.0, 5.0), (4, 100.0, 5.0)],
                                  "k long, x double, c double")
    test = spark.createDataFrame([(9, None, 7.0)], "k long, x double, c double")
    tr, te = prep.impute_mean(train, [test], ["x", "c"])
    m = (1 + 3 + 100) / 3                                    # mean taken with the outlier present
    assert {r.k: r.x for r in tr.collect()}[2] == pytest.approx(m)
    assert te.first().x == pytest.approx(m)
    trs, tes = prep.standardize(tr, [te], ["x", "c"])
    xs = np.array([r.x for r in tr.orderBy("k").collect()])
    got = [r.x for r in trs.orderBy("k").collect()]
    assert got == pytest.approx(list((xs - xs.mean()) / xs.std(ddof=1)))
    assert {r.c for r in trs.collect()} == {0.0} and tes.first().c == 0.0   # constant column -> 0


def _brute_auc(labels, scores):
    pos = [s for l, s in zip(labels, scores) if l == 1]
    neg = [s for l, s in zip(labels, scores) if l == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def _brute_ap(labels, scores):
    P = sum(labels)
    ap, prev_r = 0.0, 0.0
    for t in sorted(set(scores), reverse=True):
        sel = [l for l, s in zip(labels, scores) if s >= t]
        r = sum(sel) / P
        ap += (r - prev_r) * (sum(sel) / len(sel))
        prev_r = r
    return ap


def test_curves_vs_brute_force(spark):
    rng = np.random.default_rng(7)
    labels = [int(v) for v in rng.integers(0, 2, 300)]
    scores = [float(round(v, 1)) for v in rng.normal(size=300) + np.array(labels) * 0.7]   # many ties
    df = spark.createDataFrame(list(zip(labels, scores)), "y int, s double")
    assert E.roc_auc(df, "y", "s").first()[0] == pytest.approx(_brute_auc(labels, scores), abs=1e-12)
    assert E.average_precision(df, "y", "s").first()[0] == pytest.approx(_brute_ap(labels, scores), abs=1e-12)
    roc = E.roc_curve(df, "y", "s").collect()
    assert (roc[0].fpr, roc[0].tpr) == (0.0, 0.0) and max(r.tpr for r in roc) == 1.0
    pr = E.pr_curve(df, "y", "s").collect()
    assert any(r.threshold is None and r.precision == 1.0 and r.recall == 0.0 for r in pr)
    assert len(pr) == len(set(scores)) + 1
    cut = E.pr_curve(df, "y", "s", stop_at_full_recall=True).collect()
    assert {r.threshold for r in cut} == {None} | {t for t in scores if t >= min(s for l, s in zip(labels, scores) if l)}


def test_hard_label_identities(spark):
    labels = [1, 1, 0, 0, 0, 1, 0, 0]
    preds = [1, 0, 0, 1, 0, 1, 0, 0]
    df = spark.createDataFrame(list(zip(labels, preds)), "y int, p int")
    cm = {(r.actual_late_flag, r.predicted_late_flag): r.cnt for r in E.confusion_matrix(df, "y", "p").collect()}
    assert sum(cm.values()) == len(labels)
    tp, fp, fn, tn = cm[(1, 1)], cm[(0, 1)], cm[(1, 0)], cm[(0, 0)]
    P, N = tp + fn, fp + tn
    prec, rec = tp / (tp + fp), tp / P
    assert E.average_precision(df, "y", "p").first()[0] == pytest.approx(prec * rec + P / (P + N) * (1 - rec))
    assert E.roc_auc(df, "y", "p").first()[0] == pytest.approx((tp / P + tn / N) / 2)
    assert E.accuracy(df, "y", "p").first().accuracy == pytest.approx((tp + tn) / len(labels))


def test_all_one_class_auc_is_null(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.5)], "y int, s double")
    assert E.roc_auc(df, "y", "s").first()[0] is None


def test_r2_rmse(spark):
    y = np.array([1.0, 2.0, 3.0, 4.5])
    p = np.array([1.1, 1.9, 3.2, 4.0])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, p double")
    r = E.r2_rmse(df, "y", "p").first()
    assert r.r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert r.rmse == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
