import numpy as np
import pytest
from pyspark.sql import functions as F

from shipcast.operators import levels as L
from shipcast.operators import levelstate as S


def _frame(spark):
    rows = ([("a", 1)] * 4 + [("a", 0)] * 16      # 20 rows, odds 0.2
            + [("b", 0)] * 20                      # 20 rows, odds 0.0
            + [("c", 1)] * 1 + [("c", 0)] * 9      # 10 rows, odds 0.1
            + [(None, 1)] * 5)                     # null level
    return spark.createDataFrame(rows, "v string, late int")


def test_level_odds_drop_null_and_sum(spark):
    df = _frame(spark)
    odds = L.level_odds(df, ["v"], "late")
    got = {r.ctgry_lvl: (r.nbr, r.nbr_late) for r in odds.collect()}
    assert got == {"a": (20, 4), "b": (20, 0), "c": (10, 1)}


def test_impactful_thresholds_are_strict(spark):
    df = _frame(spark)   # overall rate = 10 / 55
    odds = L.level_odds(df, ["v"], "late")
    imp = L.impactful_levels(odds, df, "late", lowcard=["v"], hicard=[], min_low=10)
    got = {r.ctgry_lvl: r.major_impact_flag for r in imp.collect()}
    # overall 10/55: a (0.2) is inside 0.75x..1.25x; b (0.0) is a major level; c (0.1) is
    # impactful (< 0.75x) but not major (not < 0.5x)
    assert got == {"b": 1, "c": 0}
    # c has 10 rows = min_low -> included only with >=
    imp2 = L.impactful_levels(odds, df, "late", lowcard=["v"], hicard=[], min_low=11)
    assert {r.ctgry_lvl for r in imp2.collect()} == {"b"}


def test_odds_with_others_totals(spark):
    df = _frame(spark)
    odds = L.level_odds(df, ["v"], "late")
    keys = spark.createDataFrame([("v", "b")], "variabl string, ctgry_lvl string")
    got = {r.ctgry_lvl_str: (r.nbr, r.nbr_late) for r in L.odds_with_others(odds, keys).collect()}
    assert got == {"b": (20, 0), L.ALL_OTHERS_ODDS: (30, 5)}


def test_group_rare_levels_and_encoding(spark):
    df = spark.createDataFrame([(1, "x y"), (2, "z"), (3, None), (4, "00123")], "k long, v string")
    movers = spark.createDataFrame([("v", "x y"), ("v", "00123")], "variabl string, ctgry_lvl string")
    g = {r.k: r.v__grpd for r in L.group_rare_levels(df, movers, ["v"]).collect()}
    assert g == {1: "x y", 2: L.ALL_OTHERS_GROUPED, 3: L.ALL_OTHERS_GROUPED, 4: "00123"}
    levels = spark.createDataFrame([("v", "x y"), ("v", "00123")], "variabl string, ctgry_lvl string")
    enc = {r.k: r.dummy for r in L.one_hot_long(df, "k", ["v"], levels, "_").collect()}
    assert enc == {1: "v_x_y", 4: "v_00123"}     # unseen level 'z' and null -> all zeros


def _wide(spark):
    rows = [(i, f"u{i % 7}", None if i % 5 == 0 else f"w {i % 11}", i % 3) for i in range(200)]
    return spark.createDataFrame(rows, "Rww_ID long, u string, w string, z int")


def _lookup(rows, listed):
    slots = {}
    for v, lvl in sorted(listed):
        slots[(v, lvl)] = sum(1 for x in slots if x[0] == v)
    return {r[0]: tuple(slots.get((c, None if x is None else str(x))) for c, x in zip("uwz", r[1:])) for r in rows}


def test_all_columns_are_encoded_in_one_step_both_ways(spark):
    df = _wide(spark)
    listed = [("u", "u1"), ("u", "u5"), ("w", "w 3"), ("w", "w 10"), ("z", "2"), ("u", "u1")]
    dictionary = L.level_dictionary(spark.createDataFrame(listed, "variabl string, ctgry_lvl string"))
    want = _lookup([tuple(r) for r in df.collect()], set(listed))
    for most in (100, 2):  # one row of maps; one join of the long form
        out = L.with_slots(df, dictionary, ["u", "w", "z"], "Rww_ID", most)
        assert out.columns == ["Rww_ID", "u", "w", "z", "u__slot", "w__slot", "z__slot"]
        assert {r.Rww_ID: (r.u__slot, r.w__slot, r.z__slot) for r in out.collect()} == want
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") == (1 if most == 100 else 2)  # the long form's, and back to the rows
    none = L.level_dictionary(dictionary.limit(0))
    assert all(r.u__slot is None for r in L.with_slots(df, none, ["u"], "Rww_ID").collect())


def test_a_large_dictionary_is_looked_up_without_a_join(spark):
    """Rows are not shuffled and carry no dictionary; lookups agree with the joins, also where keys repeat."""
    df = spark.range(9000).select((F.col("id") % 4000).alias("Rww_ID"), F.concat(F.lit("é:"), F.col("id") % 7000).alias("u"),
                                  F.when(F.col("id") % 5 > 0, F.col("id") % 9).alias("u:1"))
    levels = (spark.range(6500).select(F.lit("u").alias("variabl"), F.concat(F.lit("é:"), "id").alias("ctgry_lvl"))
              .unionByName(spark.createDataFrame([("u:1", "3"), ("u:1", "8"), ("u", "1:3"), ("u", "")], "variabl string, ctgry_lvl string")))
    dictionary = L.level_dictionary(levels)
    out = L.with_slots(df, dictionary, ["u", "u:1"], "Rww_ID")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("scalar-subquery", 1)[0] and plan.count("Join ") == 0
    slots = {(r.variabl, r.ctgry_lvl): r.slot for r in dictionary.collect()}
    rows = out.collect()
    assert len(rows) == 9000 and len(slots) == 6504
    for r in rows:
        assert r["u__slot"] == slots.get(("u", r["u"]))
        assert r["u:1__slot"] == slots.get(("u:1", None if r["u:1"] is None else str(r["u:1"])))


def test_too_many_levels_are_refused(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_SLOTS", 3)
    with pytest.raises(ValueError, match="levels"):
        L.level_dictionary(spark.range(4).selectExpr("'v' AS variabl", "string(id) AS ctgry_lvl"))


def test_merged_states_equal_one_run(spark):
    rng = np.random.default_rng(2)
    rows = [(f"a{i % 3}", "hot" if i % 3 else f"c{i % 40}", float(rng.integers(1, 10**6)) / 86400 if i % 17 else None) for i in range(6000)]
    df = spark.createDataFrame(rows, "a string, b string, y double").withColumn("i", F.monotonically_increasing_id())
    batches = [df.where(f"pmod(hash(i), 3) = {k}") for k in range(3)]
    parts = [S.level_state(b, ["a", "b"], "y", 86400.0) for b in batches]
    merged = S.merge_states(S.merge_states(parts[2], parts[0]), parts[1])
    one = S.level_state(df, ["a", "b"], "y", 86400.0)
    cols = ["variabl", "ctgry_lvl", "nbr", "total", "squares", "low", "high"]
    assert sorted(map(tuple, merged.select(*cols).collect())) == sorted(map(tuple, one.select(*cols).collect()))
    exact = {}
    for a, b, y in rows:
        if y is not None:
            exact.setdefault(("a", a), []).append(y)
            exact.setdefault(("b", b), []).append(y)
    ps = [0.05, 0.25, 0.5, 0.75, 0.99]
    got = {(r.variabl, r.ctgry_lvl): r for r in S.state_stats(merged, 86400.0, ps).collect()}
    assert set(got) == set(exact)
    for k, values in exact.items():
        values = np.sort(values)
        r = got[k]
        assert r.nbr == len(values) and r.lvl_mean == pytest.approx(values.mean(), rel=1e-12)
        assert r.lvl_std == pytest.approx(values.std(ddof=1), rel=1e-9)
        for p, q in zip(ps, r.q):  # rank error
            below, upto = np.searchsorted(values, q), np.searchsorted(values, q, side="right")
            assert max(below - p * len(values), p * len(values) - upto, 0) <= S.RANK_ERROR * len(values) + 1


def test_distinct_sketches_merge_within_their_bound(spark):
    df = spark.range(30000).selectExpr("string(id) AS a", "string(id % 50) AS b", "if(id % 2 = 0, string(id % 999), null) AS c", "id")
    state = S.merge_distinct(*[S.distinct_state(df.where(f"id % 3 = {k}"), ["a", "b", "c"]) for k in range(3)])
    got = {r.variabl: r for r in S.distinct_estimate(state).collect()}
    for v, n in (("a", 30000), ("b", 50), ("c", 999)):
        assert got[v].low_est <= n <= got[v].high_est
        assert abs(got[v].nbr_lvls_est - n) <= S.DISTINCT_ERROR * n + 1


def test_distinct_sketch_query_splits_its_batches_by_date(spark, monkeypatch):
    """The rows that the query stores hold the date that its two batches are told apart by."""
    from shipcast import catalog, catalog_levels as C
    from shipcast.operators import features
    from shipcast.plans import variables as V

    cols = dict.fromkeys([*features.CLF_COMPLETE_CASE_COLS, V.CLF_TARGET, *V.CLF_CATEGORICAL])
    rows = spark.range(400).select(
        F.col("id").alias("Rww_ID"),
        *[F.when(F.col("id") % 4 > 0, F.make_date(1990 + F.col("id") % 10, F.lit(1), F.lit(1)).cast("timestamp_ntz"))
          .otherwise(F.lit("1995-12-31 23:59:59").cast("timestamp_ntz")).alias(c) if c == "order_purchase_timestamp"
          else (F.col("id") % (3 + i)).alias(c) for i, c in enumerate(cols)])
    monkeypatch.setattr(C.ds, "order_features", lambda *a: rows)
    got = {r.variabl: (r.nbr_lvls, r.within_bound) for r in catalog.QUERIES["level_cardinality_sketch"](spark, "").collect()}
    train, _ = C.ds.split(rows)
    want = train.agg(*[F.count_distinct(c).alias(c) for c in V.CLF_CATEGORICAL]).first().asDict()
    assert got == {c: (n, True) for c, n in want.items()}
