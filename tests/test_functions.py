"""Column rules on hand-made edge rows (missing-value and boundary semantics)."""
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shipcast.functions import geo, timing

T0 = datetime(2018, 3, 1, 0, 0, 0)


def test_late_flag_rules(spark):
    est = T0
    rows = [(est + timedelta(days=1), est), (est + timedelta(days=1, seconds=-1), est),
            (est + timedelta(days=1, seconds=1), est), (None, est), (est + timedelta(seconds=1), est)]
    df = spark.createDataFrame(rows, "d timestamp_ntz, e timestamp_ntz")
    out = df.select(timing.late_flag("d", "e").alias("py"), timing.late_flag("d", "e", "grace_strict").alias("r"),
                    timing.late_flag("d", "e", "strict").alias("s")).collect()
    assert [tuple(r) for r in out] == [(1, 0, 1), (0, 0, 1), (1, 1, 1), (0, 0, 0), (0, 0, 1)]
    with pytest.raises(ValueError):
        timing.late_flag("d", "e", "nope")


def test_days_remaining_null_rules(spark):
    c, s, e = T0, T0 + timedelta(days=2), T0 + timedelta(days=10)
    rows = [(c, s, e), (None, s, e), (c, None, e), (s, s, e), (s + timedelta(days=1), s, e)]
    df = spark.createDataFrame(rows, "c timestamp_ntz, s timestamp_ntz, e timestamp_ntz")
    got = [r[0] for r in df.select(timing.days_remaining("c", "s", "e")).collect()]
    # carrier earlier -> from carrier; carrier missing -> from ship limit; ship limit missing -> null
    assert got == [10.0, 8.0, None, 8.0, 8.0]


def test_est_days_ceil_and_flag_after(spark):
    df = spark.createDataFrame([(T0, T0 + timedelta(days=3, seconds=1), None)],
                               "p timestamp_ntz, e timestamp_ntz, x timestamp_ntz")
    r = df.select(timing.est_delivery_days("p", "e"), timing.flag_after("x", "p"), timing.flag_after("e", "p")).first()
    assert tuple(r) == (4, 0, 1)


def test_calendar(spark):
    df = spark.createDataFrame([(datetime(2017, 8, 7, 13, 0),)], "t timestamp_ntz")  # a Monday
    r = df.select(timing.month_name("t"), timing.weekday_name("t"), timing.weekday_mon0("t"),
                  timing.year_month_int("t"), timing.year_fraction("t")).first()
    assert tuple(r) == ("August", "Monday", 0, 201708, 2017 + 7 / 12)


def test_distance_edges(spark):
    rows = [(-23.5, -46.6, -23.5, -46.6), (0.0, 0.0, 0.0, 180.0), (None, 1.0, 2.0, 3.0), (90.0, 0.0, -90.0, 0.0),
            (-23.5, -46.6, -22.9, -43.2)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = [r[0] for r in df.select(geo.distance_km("a", "b", "c", "d")).collect()]
    assert got[0] is not None and 0.0 <= got[0] < 1e-3
    assert got[1] == pytest.approx(20015.118, abs=1e-3)
    assert got[2] is None
    assert got[3] == pytest.approx(20015.118, abs=1e-3)
    assert got[4] == pytest.approx(352.6, abs=2.0)


def test_geo_box_and_state_pair(spark):
    rows = [(-34.0, -74.0, "A", "A"), (6.0, -34.0, None, None), (6.01, -40.0, "A", None), (-20.0, -73.99, None, "B")]
    df = spark.createDataFrame(rows, "lat double, lng double, cs string, ss string")
    out = df.select(geo.mask_outside_box(F.lit(1.0), "lat", "lng").alias("m"), geo.state_pair("cs", "ss").alias("p"),
                    geo.same_state("cs", "ss").alias("same"), geo.state_flag("cs", "A").alias("f")).collect()
    assert [r.m for r in out] == [1.0, 1.0, None, 1.0]
    assert [r.p for r in out] == ["A-A", "nan-nan", "A-nan", "nan-B"]
    assert [r.same for r in out] == [1, 1, 0, 0]
    assert [r.f for r in out] == [1, 0, 1, 0]
