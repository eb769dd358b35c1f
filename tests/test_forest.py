"""A forest as a table, and all depths and sizes of a sweep from one fit."""

import numpy as np
import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from shipcast.plans import forest as T
from shipcast.plans import models as M


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 4)).round(3)
    y = 2 * x[:, 0] + np.sin(3 * x[:, 1]) + rng.normal(size=900) * 0.3
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))],
                               "id long, a double, b double, c double, d double, y double")
    return df, M.assemble(df, list("abcd"), keep=["id", "y"]).cache()


def fit(frame, trees, depth):
    return RandomForestRegressor(labelCol="y", numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", seed=M.SEED).fit(frame)


def predictions(frame):
    return {r.id: r.prediction for r in frame.collect()}


def test_cut_off_forest_equals_separate_fits(spark, data):
    _, frame = data
    forest = T.forest_table(fit(frame, 5, 14))
    depths = [0, 1, 4, 9, 14, 20]
    got = {r.id: r.predictions for r in T.staged_predictions(frame, forest, depths, [5], ["id"]).collect()}
    for place, depth in enumerate(depths):
        if depth <= 14:
            want = predictions(fit(frame, 5, depth).transform(frame))
            assert all(got[i][place] == pytest.approx(want[i], rel=1e-12) for i in want)
    assert all(p[5] == p[4] for p in got.values())


def test_first_trees_are_the_smaller_forest(spark, data):
    _, frame = data
    model = fit(frame, 6, 5)
    got = T.staged_predictions(frame, T.forest_table(model), [2, 5], [1, 4, 6], ["id"]).collect()
    whole = predictions(model.transform(frame))
    each = [predictions(t.transform(frame)) for t in model.trees]
    for r in got:
        assert len(r.predictions) == 6
        assert r.predictions[5] == pytest.approx(whole[r.id])
        assert r.predictions[3] == pytest.approx(np.mean([t[r.id] for t in each[:4]]))
        assert r.predictions[1] == pytest.approx(each[0][r.id])


def test_sweep_scores_every_point(spark, data):
    df, _ = data
    train, test = df.where("id % 4 > 0"), df.where("id % 4 = 0")
    got = {(r.num_trees, r.max_depth): r for r in M.rf_sweep(train, test, "y", list("abcd"), depths=[1, 3, 8], trees=[3, 5],
                                                            train_cap=None).collect()}
    assert set(got) == {(t, d) for t in (3, 5) for d in (1, 3, 8)}
    tr, te = (M.assemble(d.withColumn("_y", F.col("y")), list("abcd"), keep=["_y"]) for d in (train, test))
    for depth in (1, 3, 8):
        model = RandomForestRegressor(labelCol="_y", numTrees=5, maxDepth=depth, featureSubsetStrategy="all", seed=M.SEED).fit(tr)
        want = M._r2_rmse(model.transform(te))
        assert got[(5, depth)].r2_test == pytest.approx(want["r2"]) and got[(5, depth)].rmse_test == pytest.approx(want["rmse"])
    assert got[(5, 8)].r2_train > got[(5, 1)].r2_train


def test_indicator_splits_follow_the_model(spark, data):
    """Encoded levels are split as categories."""
    df, _ = data
    rows = df.withColumn("u", F.concat(F.lit("l"), (F.col("id") % 5).cast("string"))).withColumn(
        "y", F.col("y") + F.when(F.col("u") == "l3", 9).when(F.col("u") == "l1", -5).otherwise(0))
    levels = spark.createDataFrame([("u", f"l{i}") for i in range(4)], "variabl string, ctgry_lvl string")
    (encoded,), cols, _ = M.encode_levels([rows], levels, key="id")
    frame = M.assemble(encoded, ["a", *cols, "b"], keep=["id", "y"]).cache()
    model = fit(frame, 4, 6)
    want = predictions(model.transform(frame))
    got = T.staged_predictions(frame, T.forest_table(model), [6], [4], ["id"]).collect()
    assert all(r.predictions[0] == pytest.approx(want[r.id]) for r in got)


def test_limits_of_a_forest(spark, data):
    _, frame = data
    forest = T.forest_table(fit(frame, 2, 3))
    with pytest.raises(ValueError, match="nodes"):
        T.staged_predictions(frame, forest, [3], [2], ["id"], max_nodes=3)
    with pytest.raises(ValueError, match="trees"):
        T.staged_predictions(frame, forest, [3], [5], ["id"])
    assert T.staged_scores(T.staged_predictions(frame.limit(0), forest, [3], [2], ["y"]), "y", 1) == [(None, None)]
    leaves = forest.where("feature IS NULL")
    assert leaves.where("left_child >= 0 OR threshold IS NOT NULL").count() == 0
    assert forest.where("node = 0").agg(F.min("n")).first()[0] > 500


@pytest.mark.parametrize("part_nodes", [T.PART_NODES, 100])
def test_forest_classifier_is_scored_from_its_table(spark, data, monkeypatch, part_nodes):
    """The table gives MLlib's probabilities and flags; no frame is sent the model."""
    from pyspark.ml.functions import vector_to_array
    monkeypatch.setattr(T, "PART_NODES", part_nodes)  # trees fetched together or one by one
    df, _ = data
    rows = df.withColumn("u", F.concat(F.lit("l"), (F.col("id") % 5).cast("string"))).withColumn(
        "late", (F.col("y") + F.when(F.col("u") == "l3", 2).otherwise(0) > 1).cast("int"))
    levels = spark.createDataFrame([("u", f"l{i}") for i in range(4)], "variabl string, ctgry_lvl string")
    (encoded,), vectors, _ = M.encode_levels([rows], levels, key="id")
    cols = ["a", *vectors, "b"]
    train, test = (encoded.where(c).select("id", "late", *cols).cache() for c in ("id % 3 > 0", "id % 3 = 0"))
    got = M.classify(train, {"test": test, "none": test.limit(0)}, cols, "late", "rf", key="id", trees=5, depth=6)
    for name, df in (("train", train), ("test", test)):
        plan = got[name]._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "probability" not in plan
        want = {r.id: r for r in got["_model"].transform(M._with_features(df, cols, "late", "id"))
                .select("id", "label", "prediction", vector_to_array("probability")[1].alias("p")).collect()}
        found = got[name].collect()
        assert len(found) == len(want) == df.count()
        for r in found:
            assert (r.late, r.predicted_late_flag, r.prob_late) == (want[r.id].label, want[r.id].prediction, want[r.id].p)
    assert got["none"].collect() == []


def test_forest_classifier_with_one_class(spark, data):
    """No row is late: no vote is for late, and a tree is its root."""
    _, frame = data
    rows = frame.select("id", F.col("features").alias("x"), F.lit(0).alias("late"))
    got = M.classify(rows, {}, ["x"], "late", "rf", key="id", trees=2, depth=3)["train"].collect()
    assert len(got) == 900 and {(r.late, r.predicted_late_flag, r.prob_late) for r in got} == {(0, 0, 0.0)}


def test_importances_of_a_classifier_score_nothing(spark, data, monkeypatch):
    from shipcast import catalog, catalog_models
    _, frame = data
    rows = frame.select(F.col("id").alias("Rww_ID"), F.col("features").alias("x"), (F.col("y") > 1).cast("int").alias("late_delivery_flag"))
    monkeypatch.setattr(catalog_models, "_clf_frames", lambda *a, **k: (rows, rows, ["x"], list("abcd")))
    monkeypatch.setattr(M, "classify", lambda *a, **k: pytest.fail("frames are scored"))
    monkeypatch.setattr(M, "random_forest", lambda trees, depth, make=M.random_forest: make(3, 4))
    got = catalog.QUERIES["rf_clf_importances"](spark, "")
    assert {r.feature for r in got.collect()} == set("abcd")


@pytest.mark.parametrize("depth", [10, 12])
def test_deep_sweep_keeps_the_nodes_of_rows(spark, data, monkeypatch, depth):
    """Passes over deep trees are not sent the trees; the fitted forest is read once for train and test."""
    made, read = [], []
    monkeypatch.setattr(M, "RandomForestRegressor", lambda **k: made.append(k) or RandomForestRegressor(**k))
    monkeypatch.setattr(T._Trees, "__init__", lambda *a, init=T._Trees.__init__: read.append(1) or init(*a))
    df, _ = data
    got = M.rf_sweep(df.where("id < 200"), df.where("id >= 800"), "y", list("abcd"), depths=[2, depth], trees=[2], train_cap=None)
    assert len(got.collect()) == 2 and len(read) == 1
    assert [k["cacheNodeIds"] for k in made] == [depth > 10]
