from datetime import datetime, timedelta

from shipcast.operators import audit, rollups

T = datetime(2018, 1, 1)
H = timedelta(hours=1)
COLS = ("order_id string, order_purchase_timestamp timestamp_ntz, order_approved_at timestamp_ntz, "
        "order_delivered_carrier_date timestamp_ntz, order_delivered_customer_date timestamp_ntz, "
        "order_estimated_delivery_date timestamp_ntz")


def frame(spark):
    rows = [
        ("ok", T, T + H, T + 2 * H, T + 3 * H, T + 99 * H),
        ("p>a", T + H, T, T + 2 * H, T + 3 * H, T + 99 * H),
        ("a>c", T, T + 3 * H, T + 2 * H, T + 4 * H, T + 99 * H),
        ("tie", T, T + H, T + 2 * H, T + 2 * H, T + H),     # carrier == customer: counted by >=, kept by <=
        ("nul", T, None, T + 2 * H, None, T + 99 * H),
    ]
    return spark.createDataFrame(rows, COLS)


def test_chronology_counts(spark):
    got = {r.rule: r.n_rows for r in audit.chronology_violations(frame(spark)).collect()}
    assert got == {"purchase_after_approval": 1, "approval_after_carrier": 1, "purchase_after_carrier": 0,
                   "carrier_not_before_customer": 1, "approval_after_customer": 0, "purchase_after_customer": 0}


def test_clean_timeline_keeps_ties(spark):
    kept = sorted(r.order_id for r in audit.clean_timeline(frame(spark)).collect())
    assert kept == ["ok", "p>a", "tie"]


def test_suspect_and_null_census(spark):
    s = {r.approval_suspect: (r.n_rows, r.n_late) for r in audit.suspect_approvals(frame(spark)).collect()}
    assert s == {0: (3, 1), 1: (1, 0)}
    nulls = {r.column_name: r.n_null for r in audit.null_census(frame(spark)).collect()}
    assert nulls == {"order_approved_at": 1, "order_delivered_customer_date": 1}


def test_conditional_rates_zero_denominator_safe(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0)], "f int, late_delivery_flag int")
    got = {r.f: (r.n_orders, r.n_late, r.pct_late) for r in rollups.conditional_late_rates(df, "f").collect()}
    assert got == {1: (2, 1, 0.5), 0: (1, 0, 0.0)}


def test_split_delivery_orders_finds_orders_with_two_dates(spark):
    from datetime import datetime

    from shipcast.operators import rollups

    d = [datetime(2020, 1, 1, 5), datetime(2020, 1, 3, 7)]
    items = spark.createDataFrame([("a", d[0]), ("a", d[1]), ("a", d[0]), ("b", d[0]), ("b", d[0]), ("c", None), ("d", d[1])],
                                  f"order_id string, {rollups.DELIV} timestamp_ntz")
    got = rollups.split_delivery_orders(items).collect()
    assert [tuple(r) for r in got] == [("a", d[0], d[1])]
