"""Quantile bins, histograms and correlations against brute force."""
import numpy as np
import pytest

from shipcast.operators import distributions as D


def _brute_qbins(xs, flags, step=0.02):
    x = np.array(xs, dtype=float)
    ps = [i / round(1 / step) for i in range(round(1 / step) + 1)]
    edges = sorted(set(np.percentile(x, [p * 100 for p in ps], method="linear")))
    out = {}
    for v, f in zip(xs, flags):
        b = max(1, sum(1 for e in edges if e < v))
        n, late = out.get(b, (0, 0))
        out[b] = (n + 1, late + f)
    return edges, out


def test_quantile_bins_ties_edges_nulls(spark):
    xs = [1.0] * 30 + [2.0] * 5 + [3.0, 4.0, 5.0, 5.0, 10.0] + [7.5] * 10
    flags = [i % 3 == 0 for i in range(len(xs))]
    rows = [(x, int(f)) for x, f in zip(xs, flags)] + [(None, 1)]
    df = spark.createDataFrame(rows, "x double, late_delivery_flag int")
    got = {r.bin: (r.nbr, r.nbr_late) for r in D.quantile_bin_odds(df, ["x"]).collect()}
    edges, want = _brute_qbins(xs, [int(f) for f in flags])
    assert got == want
    assert sum(n for n, _ in got.values()) == len(xs)


def test_histogram_closed_sides(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 5, 9, 10]], "x double")
    left = {r.bin: r.n for r in D.histogram(df, "x", bins=10).collect()}
    assert left == {0: 1, 1: 1, 2: 1, 5: 1, 9: 2}   # [a, b) with the last bin closed
    right = {r.bin: r.n for r in D.histogram(df, "x", bins=10, right=True, lo=0.0, width=1.0).collect()}
    assert right == {0: 2, 1: 1, 4: 1, 8: 1, 9: 1}   # (a, b] with the first bin closed


def test_corr_pairwise_vs_numpy(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=200)
    b = a * 0.5 + rng.normal(size=200)
    c = rng.normal(size=200)
    rows = [(float(x), float(y) if i % 7 else None, float(z)) for i, (x, y, z) in enumerate(zip(a, b, c))]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r.col_i, r.col_j): r.corr for r in D.corr_pairs(df, ["a", "b", "c"]).collect()}
    mask = np.array([i % 7 != 0 for i in range(200)])
    assert got[("a", "b")] == pytest.approx(np.corrcoef(a[mask], b[mask])[0, 1], abs=1e-12)
    assert got[("a", "c")] == pytest.approx(np.corrcoef(a, c)[0, 1], abs=1e-12)
    lw = {(r.col_i, r.col_j): r.corr for r in D.corr_pairs(df, ["a", "b", "c"], listwise=True).collect()}
    assert lw[("a", "c")] == pytest.approx(np.corrcoef(a[mask], c[mask])[0, 1], abs=1e-12)


def test_box_stats_whiskers(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    df = spark.createDataFrame([("g", v) for v in vals], "g string, v double")
    r = D.box_stats(df, "v", ["g"]).first()
    q1, q3 = np.percentile(vals, [25, 75])
    assert (r.q1, r.q3) == (q1, q3)
    assert r.whisker_hi == 5.0 and r.whisker_lo == 1.0 and r.n_outliers == 1


def test_group_quantiles_vs_numpy(spark):
    rng = np.random.default_rng(2)
    ps = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    groups = {"a": rng.normal(size=501).round(1), "b": rng.normal(size=64), "c": np.array([3.0]), "d": np.full(40, 2.0)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.n, r.q) for r in D.group_quantiles(df, ["g"], "v", ps).collect()}
    assert set(got) == set(groups)
    tied = spark.createDataFrame([("t", 1627.9903171)] * 7 + [("t", 1.0)], "g string, v double")
    assert set(D.group_quantiles(tied, ["g"], "v", [i / 50 for i in range(10, 51)]).first().q) == {1627.9903171}
    for g, vs in groups.items():
        assert got[g][0] == len(vs)
        assert got[g][1] == pytest.approx(np.quantile(vs, ps).tolist(), abs=1e-12)


def test_histogram_counts_values_below_the_first_break(spark):
    df = spark.createDataFrame([(-3.0,), (-0.1,), (0.0,), (0.4,), (1.0,), (1.2,)], "x double")
    got = [tuple(r) for r in D.histogram(df, "x", right=True, lo=0.0, width=1.0).orderBy("bin").collect()]
    assert got == [(-1, None, 0.0, 2), (0, 0.0, 1.0, 3), (1, 1.0, 2.0, 1)]


def test_rounding_leaves_large_values_alone(spark):
    from shipcast.catalog import r6, r9

    df = spark.createDataFrame([(2.5e10,), (-2.5e10,), (1e300,), (1.23456789012,), (-0.5,), (None,)], "x double")
    got = df.select(r6("x", "a"), r9("x", "b")).collect()
    assert [r.a for r in got] == [2.5e10, -2.5e10, 1e300, 1.234568, -0.5, None]
    assert [r.b for r in got] == [2.5e10, -2.5e10, 1e300, 1.23456789, -0.5, None]


def test_many_quantiles_take_no_expression_each(spark):
    """1,000 quantiles (unrolled, their code passed the 64 KB of a JVM method and ran uncompiled)."""
    import numpy as np

    from shipcast.operators import distributions as D
    values = np.random.default_rng(2).normal(size=3000).round(2)
    df = spark.createDataFrame([(i % 2, float(v)) for i, v in enumerate(values)], "g int, v double")
    ps = [i / 999 for i in range(1000)]
    q = D.group_quantiles(df, ["g"], "v", ps)
    assert q._jdf.queryExecution().optimizedPlan().toString().count("element_at") <= 8
    for r in q.collect():
        assert r.n == 1500
        assert np.allclose(r.q, np.quantile(values[r.g::2], ps), atol=1e-12)


def test_correlations_read_the_rows_once(spark):
    from shipcast.operators import distributions as D

    seen = spark.sparkContext.accumulator(0)

    def passing(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.range(100).selectExpr("cast(id as double) a", "cast(id * id as double) b").mapInPandas(passing, "a double, b double")
    want = np.corrcoef(np.arange(100.0), np.arange(100.0) ** 2)[0, 1]
    assert D.corr_pairs(df, ["a", "b"]).first()["corr"] == pytest.approx(want)
    assert seen.value == 100
