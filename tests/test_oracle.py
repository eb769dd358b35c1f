"""Registered queries against their DuckDB oracle on the smallest tables."""
import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
import oracle_check  # noqa: E402

from conftest import SF_SMALL  # noqa: E402

KEYS = ["order_rollup", "build_order_items", "chronology_violations", "conditional_late_rates", "null_census",
        "late_rate_by_est_days", "describe_numeric", "odds_by_quantile_bin", "corr_listwise", "level_odds",
        "impactful_levels", "group_rare_levels", "hash_split", "undersample_balanced", "standardize",
        "roc_curve", "average_precision", "ols_duration", "gnb_params", "scan_orders", "stream_scoring"]


@pytest.fixture(scope="module")
def duck():
    return oracle_check.duck(SF_SMALL)


def test_every_oracle_key_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    got = entry.queries()[key](spark, SF_SMALL).toPandas()
    want = duck.execute(entry.oracle_sql()[key]).df()
    assert oracle_check.compare(got, want) is None


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["shipping_limit_problem_flag", "n_orders", "n_late", "pct_late"]
    assert sum(r.n_orders for r in rows) > 0
