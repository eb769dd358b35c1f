import numpy as np
import pytest

from shipcast.plans import models as M


def test_ols_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x1, x2 = rng.normal(size=120), rng.integers(1, 6, 120).astype(float)
    y = 2.0 + 0.7 * x1 - 0.3 * x2 + rng.normal(scale=0.5, size=120)
    rows = [(float(a), float(b), float(c)) for a, b, c in zip(y, x1, x2)] + [(None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "y double, x1 double, x2 double")
    fit = M.ols(df, "y", ["x1", "x2"])
    X = np.column_stack([x1, x2, np.ones(120)])
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    got = {r.term: r for r in fit.coefficients.collect()}
    assert [got["x1"].estimate, got["x2"].estimate, got[M.INTERCEPT].estimate] == pytest.approx(list(beta))
    resid = y - X @ beta
    s2 = resid @ resid / (120 - 3)
    se = np.sqrt(np.diag(s2 * np.linalg.inv(X.T @ X)))
    assert [got["x1"].std_error, got["x2"].std_error, got[M.INTERCEPT].std_error] == pytest.approx(list(se))
    assert fit.n == 120
    diag = M.residual_diagnostics(df.withColumn("k", df.x1), fit, "k").collect()
    h = np.einsum("ij,jk,ik->i", X, np.linalg.inv(X.T @ X), X)
    assert sorted(r.leverage for r in diag) == pytest.approx(sorted(h))


def test_gaussian_nb_params(spark):
    rows = [(0, 1.0, 2.0), (0, 3.0, 2.5), (1, 10.0, 0.0), (1, 12.0, 1.0), (1, 11.0, 0.5)]
    df = spark.createDataFrame(rows, "y int, a double, b double").withColumn("Rww_ID", __import__(
        "pyspark.sql.functions", fromlist=["monotonically_increasing_id"]).monotonically_increasing_id())
    preds = M.classify(df, {}, ["a", "b"], "y", "gnb")
    params = {(k, f): (pi, th, sg) for k, f, pi, th, sg in M.gnb_params(preds["_model"], ["a", "b"])}
    arr = np.array([[r[1], r[2]] for r in rows])
    eps = 1e-9 * arr.var(axis=0).max()
    assert params[(1, "a")][1] == pytest.approx(11.0)
    assert params[(1, "a")][2] == pytest.approx(np.var([10.0, 12.0, 11.0]) + eps)
    assert params[(0, "b")][0] == pytest.approx(np.log(2 / 5))


def test_hard_label_scores_match_curves(spark):
    from shipcast.operators import evaluate as E
    labels = [1, 1, 0, 0, 0, 1, 0, 0, 1, 0]
    preds = [1, 0, 0, 1, 0, 1, 0, 0, 0, 0]
    df = spark.createDataFrame(list(zip(labels, preds)), "y int, p int")
    cells = {(a, b): sum(1 for x, z in zip(labels, preds) if (x, z) == (a, b)) for a in (0, 1) for b in (0, 1)}
    acc, ap, auc = M.hard_label_scores(cells[(0, 0)], cells[(0, 1)], cells[(1, 0)], cells[(1, 1)])
    assert ap == pytest.approx(E.average_precision(df, "y", "p").first()[0])
    assert auc == pytest.approx(E.roc_auc(df, "y", "p").first()[0])
    assert acc == pytest.approx(7 / 10)
    none_pred = spark.createDataFrame([(1, 0), (0, 0), (0, 0)], "y int, p int")
    _, ap0, auc0 = M.hard_label_scores(2, 0, 1, 0)
    assert ap0 == pytest.approx(E.average_precision(none_pred, "y", "p").first()[0])
    assert auc0 == pytest.approx(E.roc_auc(none_pred, "y", "p").first()[0])


def test_encode_levels_gives_zeros_for_other_levels(spark):
    from pyspark.ml.functions import vector_to_array

    train = spark.createDataFrame([(1, "a", "x y"), (2, "b", "x y"), (3, "z", None), (4, None, "q"), (5, "a", "q")],
                                  "k long, u string, w string")
    test = spark.createDataFrame([(6, "new", "q"), (7, "b", "x y")], "k long, u string, w string")
    levels = spark.createDataFrame([("u", "b"), ("u", "a"), ("w", "x y"), ("u", "a")], "variabl string, ctgry_lvl string")
    (tr, te), cols, names = M.encode_levels([train, test], levels)
    assert cols == ["u__ohe", "w__ohe"] and names == ["u=a", "u=b", "w=x y"]
    got = {r.k: (r.u, r.w) for d in (tr, te)
           for r in d.select("k", vector_to_array("u__ohe").alias("u"), vector_to_array("w__ohe").alias("w")).collect()}
    assert got == {1: ([1, 0], [1]), 2: ([0, 1], [1]), 3: ([0, 0], [0]), 4: ([0, 0], [0]), 5: ([1, 0], [0]),
                   6: ([0, 0], [0]), 7: ([0, 1], [1])}
    assert tr.columns == ["k", "u", "w", "u__ohe", "w__ohe"]
    assert M.encode_levels([train], levels.where("false"))[1:] == ([], [])


def test_importances_have_a_row_per_slot(spark):
    import random

    rng = random.Random(0)
    rows = [(i, rng.random(), rng.choice("abcd")) for i in range(400)]
    df = spark.createDataFrame([(i, x, c, 3 * x + (5 if c == "b" else 0)) for i, x, c in rows],
                               "k long, x double, c string, y double")
    levels = spark.createDataFrame([("c", v) for v in "abc"], "variabl string, ctgry_lvl string")
    (tr,), cols, names = M.encode_levels([df], levels)
    imp = M.rf_importances(tr, "y", ["x", *cols], ["x", *names], trees=5, depth=4).collect()
    assert {r.feature for r in imp} == {"x", "c=a", "c=b", "c=c"} and imp[0].feature == "c=b"
    assert sum(r.importance for r in imp) == pytest.approx(1)
    with pytest.raises(ValueError):
        M.rf_importances(tr, "y", ["x", *cols], ["x", "c=a"], trees=2, depth=2)


def test_ones_are_counted_in_the_sparse_vectors(spark):
    from shipcast import catalog
    import shipcast.catalog_models  # noqa: F401 - registers the query
    df = catalog.QUERIES["one_hot_vector_counts"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") == 1  # one pass, not a branch for each variable and part
    assert df.dtypes == [("slot", "string"), ("ones_train", "bigint"), ("ones_test", "bigint")]


def test_importances_prepare_the_training_rows_alone(spark, monkeypatch):
    """The test rows are not grouped, stored or encoded: reading them fails here."""
    from pyspark.sql import functions as F
    from shipcast import catalog, catalog_models as C
    from shipcast.plans import variables as V

    level = (F.col("id") % 5).cast("string")
    train = spark.range(300).select(
        F.col("id").alias("Rww_ID"), ((F.col("id") * 37) % 11 + F.when(F.col("id") % 5 == 2, 20).otherwise(3)).cast("double").alias(V.REG_TARGET),
        *[((F.col("id") * (i + 3)) % 17).cast("double").alias(c) for i, c in enumerate(V.REG_PREDICTORS)],
        *[F.when(F.col("id") % 50 > 0, F.concat(F.lit(c), level)).alias(c) for c in V.REG_HICARD])
    unread = train.withColumn(V.REG_TARGET, F.when(F.col("Rww_ID") >= 0, F.raise_error(F.lit("a test row is read")).cast("double")))
    monkeypatch.setattr(C.ds, "reg_split", lambda *a: (train, train.where("Rww_ID % 3 = 0")))
    both, te, cols, names = C._reg_with_dummies(spark, "")
    assert te.count() == 100 and f"{V.REG_HICARD[0]}__grpd={V.REG_HICARD[0]}2" in names
    monkeypatch.setattr(C.ds, "reg_split", lambda *a: (train, unread))
    monkeypatch.setattr(M, "rf_importances", lambda *a, make=M.rf_importances, **k: make(*a, **{**k, "trees": 3, "depth": 3}))
    got = catalog.QUERIES["rf_importances"](spark, "").collect()
    want = M.rf_importances(both, V.REG_TARGET, cols, names, train_cap=C.REG_CAP).collect()
    assert got == want and {r.feature for r in got} == set(names)
