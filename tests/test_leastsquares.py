"""Least squares by merged QR factors, and the certificate of the logistic fit."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shipcast.plans import leastsquares as Q
from shipcast.plans import models as M


def frame(spark, x, y, parts=7):
    rows = [(*map(float, r), float(v)) for r, v in zip(x, y)]
    names = [f"x{i}" for i in range(x.shape[1])]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in [*names, "y"])).repartition(parts), names


@pytest.mark.parametrize("spread", [1.0, 1e-3, 1e-7])
def test_coefficients_of_nearly_collinear_columns(spark, spread):
    rng = np.random.default_rng(4)
    a = rng.normal(size=400) * 50 + 1e4
    x = np.column_stack([a, a + rng.normal(size=400) * spread, rng.normal(size=400)])
    y = 3 + x @ [1.0, -2.0, 0.5] + rng.normal(size=400) * 0.1 * spread
    df, names = frame(spark, x, y)
    m = Q.least_squares(df, "y", names, fan_in=2)
    full = np.column_stack([np.ones(400), x])
    want = np.linalg.lstsq(full, y, rcond=None)[0]
    fitted = full @ m.beta
    assert np.abs(fitted - full @ want).max() < 1e-6 * spread + 1e-8
    if spread >= 1e-3:
        assert m.beta == pytest.approx(want, rel=1e-5)
        # the normal matrix has lost these digits
        s = np.linalg.svd(full, compute_uv=False)
        assert s[0] / s[-1] > 1e3
    assert m.sse == pytest.approx(((y - full @ want) ** 2).sum(), rel=1e-4)


def test_standard_errors_leverage_and_dependent_columns(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 3))
    y = x @ [1.0, 2.0, -1.0] + rng.normal(size=150)
    df, names = frame(spark, x, y)
    m = Q.least_squares(df, "y", names)
    full = np.column_stack([np.ones(150), x])
    inverse = np.linalg.inv(full.T @ full)
    s2 = ((y - full @ m.beta) ** 2).sum() / 146
    assert m.std_errors() == pytest.approx(np.sqrt(np.diag(s2 * inverse)))
    assert m.r2 == pytest.approx(1 - ((y - full @ m.beta) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    got = sorted(r[0] for r in df.select(m.leverage()).collect())
    assert got == pytest.approx(sorted(np.einsum("ij,jk,ik->i", full, inverse, full)))
    twice = df.withColumn("x3", F.col("x0")).withColumn("x4", F.lit(0.0))
    d = Q.least_squares(twice, "y", [*names, "x3", "x4"])
    assert d.beta[1] == pytest.approx(m.beta[1] / 2) and d.beta[4] == pytest.approx(m.beta[1] / 2) and d.beta[5] == 0
    assert d.sse == pytest.approx(m.sse)


def test_missing_values_and_empty_table(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (None, 1.0), (3.0, None), (4.0, 8.0)], "x0 double, y double")
    m = Q.least_squares(df, "y", ["x0"])
    assert m.n == 3 and m.beta == pytest.approx([0, 2], abs=1e-12)
    assert Q.least_squares(df.limit(0), "y", ["x0"]).n == 0


@given(st.floats(-8, 8), st.integers(1, 300))
@settings(max_examples=40, deadline=None)
def test_tail_of_students_distribution(t, dof):
    grid = np.linspace(-1, 1, 200001)[1:-1]  # t = z / (1 - z^2)
    z = grid / (1 - grid ** 2)
    density = (1 + z * z / dof) ** (-(dof + 1) / 2) * (1 + grid ** 2) / (1 - grid ** 2) ** 2
    want = density[np.abs(z) >= abs(t)].sum() / density.sum()
    assert Q.t_two_sided(t, dof) == pytest.approx(want, abs=2e-3 if dof < 3 else 5e-5)


def test_linear_models_equal_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 3))
    x[:, 2] = x[:, 1] + rng.normal(size=300) * 1e-5  # nearly the same column
    y = 20 + x @ [2.0, -1.0, 4.0] + rng.normal(size=300) * 2
    df, names = frame(spark, np.column_stack([x, np.arange(300) % 4]), y)
    train, test = df.where("x3 > 0"), df.where("x3 = 0")
    models = {"all": ["x0", "x1", "x2"], "one": ["x0"]}
    got = {r.model: r for r in M.linreg_compare(train, test, "y", models, train_cap=22.0).collect()}
    part = np.arange(300) % 4
    fit, held = (part > 0) & (y <= 22.0), part == 0
    for name, cols in models.items():
        full = np.column_stack([np.ones(300)] + [x[:, int(c[1])] for c in cols])
        beta = np.linalg.lstsq(full[fit], y[fit], rcond=None)[0]
        err = y - full @ beta

        def r2(at):
            return 1 - (err[at] ** 2).sum() / ((y[at] - y[at].mean()) ** 2).sum()

        r = got[name]
        assert (r.n_train, r.n_test) == (fit.sum(), held.sum())
        assert [r.r2_train, r.r2_test, r.rmse_test] == pytest.approx([r2(fit), r2(held), np.sqrt((err[held] ** 2).mean())])


def test_gradient_of_the_logistic_loss(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 2)) * [1, 5]
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.5, -0.3] + 0.2)))).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(x, y)], "a double, b double, y int")
    rows = M.assemble(df.withColumn("label", F.col("y").cast("double")), ["a", "b"], keep=["label"]).cache()
    model = M.logistic(rows).fit(rows)
    got = {r.predictor: r for r in M.logistic_certificate(model, rows, ["a", "b"]).collect()}
    w = np.array([model.intercept, *model.coefficients])
    full = np.column_stack([np.ones(400), x])
    want = full.T @ (1 / (1 + np.exp(-full @ w)) - y) / 400 + np.array([0, w[1], w[2]]) / 400
    assert [got[p].gradient for p in (M.INTERCEPT, "a", "b")] == pytest.approx(want, abs=1e-12)
    assert max(abs(want)) < 1e-6
    worse = M.logistic(rows).setMaxIter(1).fit(rows)
    assert max(abs(r.gradient) for r in M.logistic_certificate(worse, rows, ["a", "b"]).collect()) > 1e-3


def test_many_whole_number_columns_with_missing_values(spark):
    """The plan's size does not double with each column (30 columns never ended)."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 50, size=(400, 30))
    y = x @ np.arange(30.0) + rng.normal(size=400)
    rows = [(*map(int, r), float(v)) for r, v in zip(x, y)]
    rows += [(None, *[1] * 29, 1.0), (*[1] * 30, None), (*[1] * 30, float("nan"))]
    cols = [f"x{i}" for i in range(30)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in cols) + ", y double")
    m = Q.least_squares(df, "y", cols)
    want, *_ = np.linalg.lstsq(np.column_stack([np.ones(400), x]), y, rcond=None)
    assert m.n == 400 and list(m.beta) == pytest.approx(list(want))
