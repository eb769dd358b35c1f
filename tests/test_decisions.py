"""Decision time: masks, rates as of a day, and the event-time streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shipcast.operators import pointintime as P
from shipcast.session import scratch_path
from shipcast.streaming import decisions as D

T0 = dt.datetime(2020, 1, 1)


def at(days):
    return None if days is None else T0 + dt.timedelta(days=days)


ORDER = "key long, purchased_at timestamp, ship_limit_at timestamp, approved_at timestamp, estimated_at timestamp"


def orders(spark, rows):
    return spark.createDataFrame([(k, at(p), at(s), at(a), at(e)) for k, p, s, a, e in rows], ORDER)


def hand_offs(spark, rows):
    return spark.createDataFrame([(k, at(h)) for k, h in rows], "key long, handed_at timestamp")


ROWS = [(1, 0, 4, 1, 10), (2, 0, 4, 3, 10), (3, 1, 5, None, 9), (4, 2, 6, 3, 12), (5, 20, 24, 21, 30), (6, 0, 4, 1, 10)]
HANDED = [(1, 3), (2, 4), (3, 7), (5, 22), (6, -2), (99, 3)]


def rows_of(df):
    return sorted(tuple(map(str, (r.key, r.decided_at, r.handed_at, r.shipping_limit_missed, r.shipping_limit_miss_amt,
                                  r.approval_time_days, r.days_remaining))) for r in df.collect())


def test_stream_decides_as_the_batch(spark):
    o, h = orders(spark, ROWS), hand_offs(spark, HANDED)
    batch = D.features_at_decision(D.decide(o, h, ""))
    got = {r.key: r for r in batch.collect()}
    assert (got[1].shipping_limit_missed, got[1].shipping_limit_miss_amt, got[1].days_remaining) == (0, -1, 7)
    assert (got[2].shipping_limit_missed, got[2].shipping_limit_miss_amt, got[2].approval_time_days) == (0, 0, 3)  # at the limit
    assert (got[3].shipping_limit_missed, got[3].shipping_limit_miss_amt, got[3].days_remaining) == (1, None, 4)  # after it
    assert (got[4].shipping_limit_missed, got[4].handed_at) == (1, None)
    assert (got[6].decided_at, got[6].approval_time_days) == (at(-2), None)  # approval not known yet
    assert set(got) == {1, 2, 3, 4, 5, 6}
    assert rows_of(D.replay(o, h, 2)) == rows_of(batch)
    empty = D.replay(o.limit(0), h.limit(0), 2)
    assert empty.count() == 0 and "decided_at" in empty.columns


def test_late_and_repeated_events_do_not_score_again(spark):
    """A hand-off behind the watermark, and events that come twice."""
    src, off = (fresh(spark, n) for n in ("orders", "hand_offs"))
    o = orders(spark, [(1, 0, 4, 1, 10), (2, 0, 4, 1, 10), (1, 0, 4, 1, 10)])
    clock = orders(spark, [(None, 40, None, None, None)])
    o.write.mode("append").parquet(src)
    hand_offs(spark, [(2, 1), (2, 1), (None, 40)]).coalesce(1).write.mode("append").parquet(off)
    clock.write.mode("append").parquet(src)
    sink, ckpt = fresh(spark, "out"), fresh(spark, "ckpt")
    D.run_decisions(spark, src, off, o.schema, hand_offs(spark, []).schema, sink, ckpt, "2 days")
    assert rows_by_key(spark, sink) == {1: [1], 2: [0]}
    # order 1 was decided by its limit; its hand-off in time arrives after the watermark has passed it
    hand_offs(spark, [(1, 2), (None, 60)]).coalesce(1).write.mode("append").parquet(off)
    orders(spark, [(3, 41, 45, 42, 50), (None, 60, None, None, None)]).coalesce(1).write.mode("append").parquet(src)
    D.run_decisions(spark, src, off, o.schema, hand_offs(spark, []).schema, sink, ckpt, "2 days")
    assert rows_by_key(spark, sink) == {1: [1], 2: [0], 3: [1]}


def fresh(spark, name):
    import uuid
    return scratch_path(spark, f"test_decisions_{uuid.uuid4().hex}_{name}")


def rows_by_key(spark, sink):
    found = {}
    for r in spark.read.parquet(sink).collect():
        found.setdefault(r.key, []).append(r.shipping_limit_missed)
    return found


def test_rates_count_outcomes_of_earlier_days_only(spark):
    rows = [(1, "a", 5, 9, 1), (2, "a", 9, 12, 0), (3, "a", 10, 10, 1), (4, "b", 10, 11, 1), (5, None, 10, 3, 1), (6, "a", 40, None, 0)]
    df = spark.createDataFrame([(i, s, at(d), at(k), f) for i, s, d, k, f in rows],
                               "id long, seller string, decided timestamp_ntz, known timestamp_ntz, late int")
    got = {r.id: (r.s_n, r.s_late) for r in P.asof_rates(df, "seller", "late", "decided", "known", "s").collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (1, 1), 4: (0, 0), 5: (0, 0), 6: (3, 2)}


@pytest.mark.parametrize("zone", ["UTC", "America/Sao_Paulo"])
def test_instants_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.range(1).select(F.lit("2018-11-04 00:30:00").cast("timestamp_ntz").alias("t"))  # in a daylight-saving gap there
        got = df.select(F.unix_seconds(D.instant("t")).alias("u"), (D.wall_clock(D.instant("t")) == F.col("t")).alias("same")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got.u == 1541291400 and got.same
