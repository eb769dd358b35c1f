"""Text quarantine, bucketed hand-off, lifetimes of written tables, and the package on the workers."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from shipcast import catalog_sources as C
from shipcast import session
from shipcast.sources import files

from conftest import SF_SMALL


def test_bad_rows_and_fields_go_to_a_side_table(spark):
    path = session.fresh_path(spark, "text")
    lines = ["1,2020-01-02 03:04:05,1.5,a", "2,,,", "3,soon,x,b", "4,2020-01-02 03:04:05", "5,2020-01-02 03:04:05,2,c,d", "x,2020-02-30 00:00:00,1e3,"]
    spark.createDataFrame([(line,) for line in lines], "value string").write.text(path)
    schema = _parse_datatype_string("k long, t timestamp_ntz, v double, s string")
    rows, bad = files.read_quarantined(spark, path, schema)
    assert rows.schema == schema
    assert sorted(str(tuple(r)) for r in rows.select("k", F.col("t").cast("string"), "v", "s").collect()) == sorted(map(str, [
        (1, "2020-01-02 03:04:05", 1.5, "a"), (2, None, None, None), (3, None, None, "b"), (None, None, 1000.0, None)]))
    assert sorted(map(str, map(tuple, bad.collect()))) == sorted(map(str, [
        ("t", "timestamp_ntz", "soon"), ("v", "double", "x"), (None, "fields", lines[3]), (None, "fields", lines[4]),
        ("k", "bigint", "x"), ("t", "timestamp_ntz", "2020-02-30 00:00:00")]))
    empty, none = files.read_quarantined(spark, _empty_text(spark), schema)
    assert empty.count() == 0 and none.count() == 0


def _empty_text(spark):
    path = session.fresh_path(spark, "text")
    spark.createDataFrame([], "value string").write.text(path)
    return path


def test_bucketed_tables_join_without_an_exchange(spark):
    orders, items = C.handoff_tables(spark, SF_SMALL)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = C.handoff_join(orders, items)
        n = joined.count()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert n == orders.count() > 0
    assert "Exchange" not in plan and "SortMergeJoin" in plan and "Bucketed: true" in plan


def _left(spark):
    base = os.path.join(session.ensure_checkpoint_dir(spark).removeprefix("file:"), "tables")
    return set(os.listdir(base)) if os.path.isdir(base) else set()


def test_a_scope_releases_its_own_tables_only(spark):
    outer = session.stored_table(spark.range(5), "outer")
    before = _left(spark)
    with session.table_scope(spark):
        C.q_parse_ts(spark, SF_SMALL).collect()
        C.q_checkpoint_roundtrip(spark, SF_SMALL).count()
        orders, _ = C.handoff_tables(spark, SF_SMALL)
        name = session._TABLES[-1]
        assert _left(spark) > before and orders.count() > 0
    assert _left(spark) == before
    assert not spark.catalog.tableExists(name)
    assert outer.count() == 5
    session.drop_table(outer)
    assert len(before - _left(spark)) == 1
    with pytest.raises(Exception):
        spark.read.parquet(outer.inputFiles()[0]).count()


def test_released_folder_is_empty(spark):
    frame = session.stored_table(spark.range(3), "rows")
    assert frame.count() == 3
    session.release_tables(spark)
    assert _left(spark) & {os.path.basename(p) for p in session._FRESH} == set() and not session._FRESH


def test_workers_find_the_package_from_another_folder(tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {here!r})\n"
            "import __spark_entry__ as e\nfrom shipcast.session import local_session\n"
            "spark = local_session(2, 2)\n"
            f"print('rows', e.queries()['linreg_est_only'](spark, {SF_SMALL!r}).count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 1" in out.stdout, out.stderr[-2000:]


def test_long_and_short_orders_roll_up_alike(spark, tmp_path):
    """Orders on both sides of the bound, ties, missing keys and a product listed twice."""
    import random

    from shipcast.sources import fixtures
    from shipcast.sources.tables import load_tables

    rng = random.Random(3)
    lines = [(o, rng.choice([None, 1, 2, 3, 4]), rng.choice([None, 7, 8]), i + 1, float(rng.randint(1, 99)), 0.05)
             for o, n in ((1, 1), (2, 4), (3, fixtures.LONG_ORDER), (4, fixtures.LONG_ORDER + 1), (5, 300), (None, 90)) for i in range(n)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, "
                                 "l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "a", 3), (2, "b", 4), (2, "b", 4), (3, None, None)], "p_partkey long, p_type string, p_size int").write.parquet(
        f"{tmp_path}/part.parquet")
    t = load_tables(spark, str(tmp_path))
    items = fixtures._items_with_part(t)
    want = sorted(fixtures._rollup_in_two_levels(items).collect(), key=str)
    assert sorted(fixtures._rollup_at_once(items).collect(), key=str) == want
    assert sorted(fixtures.order_item_rollup(t).collect(), key=str) == want
    assert len(want) == 6


def test_queries_leave_no_method_the_jvm_would_not_compile(spark):
    import __spark_entry__ as entry

    from shipcast.session import JIT_METHOD_BYTES
    entry.queries()["null_census"](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == JIT_METHOD_BYTES <= 8000


def test_order_features_shuffle_lines_once(spark):
    from shipcast.sources import fixtures
    from shipcast.sources.tables import load_tables
    rollup = fixtures.order_item_rollup(load_tables(spark, "/root/testdata/sf0.001"))
    plan = rollup._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1 and "Expand" not in plan


def test_most_frequent_value_without_counting(spark, tmp_path):
    """Orders whose values all differ take the smallest; others count, ties to the smallest."""
    from shipcast.sources import fixtures

    rows = [(1, 5, 9, 1), (1, 3, 8, 2), (2, 4, 7, 1), (2, 4, 7, 2), (2, 1, 6, 3), (3, 2, 5, 1), (3, 2, 4, 2), (3, 1, 5, 3), (3, 1, 4, 4),
            (4, None, None, 1)]
    items = spark.createDataFrame([(o, p, s, n, 1.0, 0.1, f"t{p}" if p else None, 2) for o, p, s, n in rows],
                                  "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, "
                                  "l_tax double, p_type string, p_size int")
    out = fixtures._rollup_at_once(items)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all(f"array_min({c}#" in plan for c in ("parts", "sellers", "types"))
    got = {r.l_orderkey: (r.product_key_mfu, r.seller_key, r.p_type_mfu) for r in out.collect()}
    assert got == {1: (3, 8, "t3"), 2: (4, 7, "t4"), 3: (1, 4, "t1"), 4: (None, None, None)}


def test_splits_store_the_columns_their_caller_reads(spark):
    from shipcast.operators import features
    from shipcast.plans import datasets as ds

    sf = "/root/testdata/sf0.001"
    for split, complete in ((ds.clf_split, features.CLF_COMPLETE_CASE_COLS), (ds.reg_split, features.REG_COMPLETE_CASE_COLS)):
        parts = split(spark, sf, ["ttl_pd", "state_pair"])
        assert all(p.columns == ["Rww_ID", "ttl_pd", "state_pair"] for p in parts)
        rows = ds.order_features(spark, sf).dropna(subset=complete).select("Rww_ID", "ttl_pd", "state_pair")
        got = parts[0].unionByName(parts[1])
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str) and rows.count() < 1500
        assert split(spark, sf)[0].columns == ds.order_features(spark, sf).columns
