"""What is known about an order when its late delivery is predicted.

The decision time of an order is the earlier of its ship limit and its hand-off to
the carrier.  ``known_at_decision`` masks what happens later; ``asof_rates`` gives
the late rate of a seller (or another level) from outcomes of earlier days only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timing
from ..functions.timing import DAY


def handed_over_in_time(carrier, ship_limit) -> Column:
    """Whether the hand-off came no later than the ship limit; a missing one did not."""
    return F.coalesce(F.col(carrier) <= F.col(ship_limit), F.lit(False))


def decision_time(carrier="order_delivered_carrier_date", ship_limit="ship_limit_final") -> Column:
    """The hand-off where it came by the ship limit, else the limit."""
    return F.when(handed_over_in_time(carrier, ship_limit), F.col(carrier)).otherwise(F.col(ship_limit))


def known_at_decision(orders: DataFrame) -> DataFrame:
    """``orders`` as they look at their decision time.

    ``shipping_limit_missed`` is 1 when the limit passed without a hand-off (also
    where none ever came); ``shipping_limit_miss_amt`` is known only for a hand-off
    in time; the approval only if it came by then.  Adds ``decision_ts``.
    """
    in_time = handed_over_in_time("order_delivered_carrier_date", "ship_limit_final")
    at = decision_time()
    approved = F.col("order_approved_at") <= at
    masked = {
        "shipping_limit_missed": F.when(in_time, F.lit(0)).otherwise(F.lit(1)),
        "shipping_limit_miss_amt": F.when(in_time, F.col("shipping_limit_miss_amt")),
        "approval_time_days": F.when(approved, F.col("approval_time_days")),
        "days_remaining": timing.days_between(at, F.col("order_estimated_delivery_date")),
    }
    return orders.select(*[masked.get(c, F.col(c)).alias(c) for c in orders.columns], at.alias("decision_ts"))


def outcome_time(delivered="order_delivered_customer_date", estimated="order_estimated_delivery_date") -> Column:
    """When it is known whether an order is late: at its delivery, or once the day after the estimate begins."""
    limit = F.timestamp_add("SECOND", F.lit(DAY), F.col(estimated))
    return F.when(F.col(delivered) < limit, F.col(delivered)).otherwise(limit)


def asof_rates(orders: DataFrame, key: str, flag: str, decided: str, known: str, prefix: str) -> DataFrame:
    """``orders`` with ``<prefix>_n`` and ``<prefix>_late``: orders of the same level
    whose outcome was known on a day before the decision's, and how many were late.

    Outcomes are added up for each level and day before a window runs along the
    days, so a level holding a third of all orders has no more rows in it than
    there are days.  A missing level has no earlier orders.
    """
    day = F.to_date(known)
    per_day = (orders.where(F.col(key).isNotNull() & F.col(known).isNotNull())
               .groupBy(F.col(key).alias("_key"), day.alias("_day"))
               .agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(flag).cast("bigint")).alias("_late")))
    asked = (orders.where(F.col(key).isNotNull() & F.col(decided).isNotNull())
             .groupBy(F.col(key).alias("_key"), F.to_date(decided).alias("_day")).agg(F.lit(1).alias("_asked")))
    days = per_day.join(asked, ["_key", "_day"], "full")
    before = Window.partitionBy("_key").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    upto = (days.select("_key", "_day", "_asked", F.sum("_n").over(before).alias("_n"), F.sum("_late").over(before).alias("_late"))
            .where("_asked = 1").drop("_asked"))
    joined = orders.join(upto, (F.col(key) == F.col("_key")) & (F.to_date(decided) == F.col("_day")), "left")
    return joined.select(*orders.columns, F.coalesce("_n", F.lit(0)).alias(f"{prefix}_n"),
                         F.coalesce("_late", F.lit(0)).alias(f"{prefix}_late"))
