"""Derived feature columns for the order-level and item-level tables.

One ``select`` adds every feature, so the plan stays a single projection
(no chain of ``withColumn`` calls).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, timing

# Fixed column lists used by the analyses (names as in the analysed data set).
REG_COMPLETE_CASE_COLS = [
    "order_purchase_timestamp", "order_delivered_customer_date", "distance_km",
    "order_approved_at", "order_delivered_carrier_date", "ttl_pd",
]
CLF_COMPLETE_CASE_COLS = [
    "order_delivered_customer_date", "distance_km", "days_remaining", "order_purchase_timestamp",
    "order_approved_at", "order_delivered_carrier_date", "order_estimated_delivery_date",
    "ship_limit_final", "nbr_items", "est_delivery_time_days", "shipping_limit_missed",
    "shipping_limit_miss_amt",
]


def order_features(oe: DataFrame) -> DataFrame:
    """Order-level features (delivery target, late flag, timing, geo, calendar).

    Naming: the two analyses use ``purchase_yr_and_mo`` and ``purchase_mo`` for
    different things; here the month number / yyyymm keep those names and the
    month-name / fractional-year variants are ``*_name`` / ``*_yr_frac``.
    """
    pts, est = F.col("order_purchase_timestamp"), F.col("order_estimated_delivery_date")
    carr, slf = F.col("order_delivered_carrier_date"), F.col("ship_limit_final")
    deliv = F.col("order_delivered_customer_date")
    return oe.select(
        "*",
        timing.days_between(pts, deliv).alias("fulfill_duration"),
        timing.late_flag(deliv, est).alias("late_delivery_flag"),
        timing.est_delivery_days(pts, est).alias("est_delivery_time_days"),
        timing.days_between(pts, F.col("order_approved_at")).alias("approval_time_days"),
        timing.flag_after(carr, slf).alias("shipping_limit_missed"),
        timing.days_between(slf, carr).alias("shipping_limit_miss_amt"),
        timing.days_remaining(carr, slf, est).alias("days_remaining"),
        geo.distance_km("lat_seller", "long_seller", "lat_customer", "long_customer").alias("distance_km"),
        geo.same_state("customer_state", "seller_state").alias("states_same_or_diff"),
        geo.state_pair("customer_state", "seller_state").alias("state_pair"),
        F.month(pts).alias("purchase_mo"),
        timing.month_name(pts).alias("purchase_mo_name"),
        timing.year_month_int(pts).alias("purchase_yr_and_mo"),
        timing.year_fraction(pts).alias("purchase_yr_frac"),
        timing.weekday_mon0(pts).alias("purchase_day_of_wk"),
        timing.weekday_name(pts).alias("purchase_day_name"),
        F.month(est).alias("est_delivery_mo"),
        timing.month_name(est).alias("est_delivery_mo_name"),
        timing.year_fraction(est).alias("est_delivery_yr_frac"),
        timing.weekday_name(est).alias("est_delivery_day_name"),
    )


def timeline_features(items: DataFrame) -> DataFrame:
    """Durations (hours) and the R-style late flag of rows with an order's dates."""
    pts, est = F.col("order_purchase_timestamp"), F.col("order_estimated_delivery_date")
    carr, deliv = F.col("order_delivered_carrier_date"), F.col("order_delivered_customer_date")
    total_h, leg_h = timing.hours_between(pts, deliv), timing.hours_between(carr, deliv)
    return items.select("*", total_h.alias("delivery_hours"), leg_h.alias("carrier_to_customer_hours"),
                        (total_h - leg_h).alias("order_to_carrier_hours"),
                        timing.late_flag(deliv, est, "grace_strict").alias("late_flag"))


def item_features(oi: DataFrame) -> DataFrame:
    """Item-level timeline features (hours), R-style late flag, masked distance."""
    dist = geo.distance_km("lat_seller", "long_seller", "lat_customer", "long_customer")
    return timeline_features(oi).select(
        "*", geo.mask_outside_box(dist, "lat_customer", "long_customer").alias("distance_km"))


def complete_cases(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows with no missing value in ``cols``."""
    return df.dropna(how="any", subset=cols)
