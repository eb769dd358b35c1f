"""Timeline column expressions (durations, late flags, calendar parts).

All are native Catalyst expressions: they stay inside whole-stage codegen.
Timestamps are TIMESTAMP_NTZ (wall-clock values); every expression here is
independent of the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _second_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def seconds_between(start, end) -> Column:
    """end - start in whole seconds (bigint); null if either is null.

    Computed from calendar fields (days between the dates x 86400 + the
    difference of the seconds of day), which is free of the session time zone:
    ``timestamp_diff`` would pass the wall-clock values through the session
    zone and lose an hour across a daylight-saving gap."""
    s, e = _c(start), _c(end)
    return (F.datediff(F.to_date(e), F.to_date(s)).cast("bigint") * DAY
            + (_second_of_day(e) - _second_of_day(s)))


def days_between(start, end) -> Column:
    return seconds_between(start, end) / float(DAY)


def hours_between(start, end) -> Column:
    return seconds_between(start, end) / 3600.0


def late_flag(delivered, estimated, rule: str = "grace_inclusive") -> Column:
    """0/1 late flag; a missing delivery date is not late (0).

    rule:
      ``grace_inclusive``  delivered >= estimated + 1 day (order-level scripts)
      ``grace_strict``     delivered >  estimated + 1 day (timeline audit)
      ``strict``           delivered >  estimated          (ad-hoc audit counts)
    """
    d, e = _c(delivered), _c(estimated)
    if rule == "grace_inclusive":
        cond = d >= F.timestamp_add("SECOND", F.lit(DAY), e)
    elif rule == "grace_strict":
        cond = d > F.timestamp_add("SECOND", F.lit(DAY), e)
    elif rule == "strict":
        cond = d > e
    else:
        raise ValueError(f"unknown late rule {rule!r}")
    return F.coalesce(cond, F.lit(False)).cast("int")


def est_delivery_days(purchase, estimated) -> Column:
    """Promised delivery time in days, rounded up to a whole day."""
    return F.ceil(days_between(purchase, estimated)).cast("int")


def flag_after(a, b) -> Column:
    """1 when a > b, 0 otherwise (including a missing operand)."""
    return F.coalesce(_c(a) > _c(b), F.lit(False)).cast("int")


def days_remaining(carrier, ship_limit, estimated) -> Column:
    """Days from the earlier of carrier hand-off / ship limit to the estimate.

    The earlier date is chosen by ``carrier <= ship_limit``; when the carrier
    date is missing that test is not true, so the ship limit is used; when
    the ship limit is missing the result is null.  (``least`` would skip the
    null and is therefore not used.)
    """
    c, s = _c(carrier), _c(ship_limit)
    start = F.when(c <= s, c).otherwise(s)
    return days_between(start, _c(estimated))


def month_name(ts) -> Column:
    return F.date_format(_c(ts), "MMMM")


def weekday_name(ts) -> Column:
    return F.date_format(_c(ts), "EEEE")


def weekday_mon0(ts) -> Column:
    """Day of week with Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(ts))


def year_month_int(ts) -> Column:
    """yyyymm as an integer, e.g. 201708."""
    return (F.year(_c(ts)) * 100 + F.month(_c(ts))).cast("int")


def year_fraction(ts) -> Column:
    """year + (month - 1) / 12."""
    return F.year(_c(ts)) + (F.month(_c(ts)) - 1) / 12.0
