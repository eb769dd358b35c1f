"""Item -> order rollups and late-rate summaries.

All are hash aggregates with map-side partial aggregation; group keys are
low-cardinality buckets or order ids, so the shuffle carries at most one
partial row per key per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timing

PTS, APPR = "order_purchase_timestamp", "order_approved_at"
CARR, DELIV = "order_delivered_carrier_date", "order_delivered_customer_date"
EST = "order_estimated_delivery_date"


def rate(num: Column, den: Column) -> Column:
    """num / den as double; null when den is 0 (no ANSI divide error)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def shipping_limit_orders(items: DataFrame) -> DataFrame:
    """Per order: latest ship limit vs carrier hand-off, and the late flag."""
    per_order = items.groupBy("order_id").agg(
        F.max("shipping_limit_date").alias("max_shipping_limit"),
        F.max(CARR).alias("delivered_to_carrier_dt"),
        F.max(DELIV).alias("delivered_to_cust_dt"),
        F.max(EST).alias("est_cust_delivery_dt"),
    )
    return per_order.select(
        "*",
        timing.flag_after("delivered_to_carrier_dt", "max_shipping_limit").alias("shipping_limit_problem_flag"),
        timing.late_flag("delivered_to_cust_dt", "est_cust_delivery_dt", "grace_strict").alias("late_delivery_flag"),
    )


def conditional_late_rates(orders: DataFrame, condition: str | Column, name: str | None = None,
                           flag: str = "late_delivery_flag") -> DataFrame:
    """Late rate split by a condition: (condition, n_orders, n_late, pct_late)."""
    cond = F.col(condition) if isinstance(condition, str) else condition
    name = name or (condition if isinstance(condition, str) else "condition")
    return (orders.groupBy(cond.alias(name))
            .agg(F.count(F.lit(1)).alias("n_orders"), F.sum(flag).cast("bigint").alias("n_late"))
            .withColumn("pct_late", rate(F.col("n_late"), F.col("n_orders"))))


def order_timing_rollup(items: DataFrame) -> DataFrame:
    """Per order: item count, approval time and promised time (days), late flag."""
    per_order = items.groupBy("order_id").agg(
        F.count(F.lit(1)).cast("int").alias("nbr_items"),
        F.max(PTS).alias("purchase_dt"),
        F.max(APPR).alias("approval_dt"),
        F.max(CARR).alias("delivered_to_carrier_dt"),
        F.max(DELIV).alias("delivered_to_cust_dt"),
        F.max(EST).alias("est_cust_delivery_dt"),
    )
    return per_order.select(
        "*",
        timing.days_between("purchase_dt", "approval_dt").alias("approval_time"),
        timing.late_flag("delivered_to_cust_dt", "est_cust_delivery_dt", "grace_strict").alias("late_delivery_flag"),
        timing.days_between("purchase_dt", "est_cust_delivery_dt").alias("est_time"),
    )


def late_rate_by(orders: DataFrame, bucket: str | Column, name: str,
                 flag: str = "late_delivery_flag") -> DataFrame:
    """(bucket, ttl_orders, orders_late, pct_late)."""
    b = F.col(bucket) if isinstance(bucket, str) else bucket
    return (orders.groupBy(b.alias(name))
            .agg(F.count(F.lit(1)).alias("ttl_orders"), F.sum(flag).cast("bigint").alias("orders_late"))
            .withColumn("pct_late", rate(F.col("orders_late"), F.col("ttl_orders"))))


def ecdf_at(df: DataFrame, col: str, x: float) -> DataFrame:
    """Empirical CDF of ``col`` at ``x`` (nulls ignored): share with value <= x."""
    c = F.col(col)
    return df.agg(
        F.count_if(c <= x).alias("n_at_or_below"),
        F.count(c).alias("n"),
        rate(F.count_if(c <= x), F.count(c)).alias("ecdf"),
    )


def late_distinct_orders(items: DataFrame, flag: str = "late_flag") -> DataFrame:
    """Late item rows and distinct late orders."""
    late = items.where(F.col(flag) == 1)
    return late.agg(F.count(F.lit(1)).alias("late_items"),
                    F.count_distinct("order_id").alias("late_orders"))


def split_delivery_orders(items: DataFrame) -> DataFrame:
    """Orders whose items were delivered on different dates (HAVING min != max)."""
    return (items.groupBy("order_id")
            .agg(F.min(DELIV).alias("min_delivery_dt"), F.max(DELIV).alias("max_delivery_dt"))
            .where(F.col("min_delivery_dt") != F.col("max_delivery_dt")))


def count_by_category(df: DataFrame, col: str) -> DataFrame:
    """Rows per level, ascending by count (the null level is kept)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy("n", col)


def delivery_stats_by_state(df: DataFrame, value: str = "delivery_hours",
                            by: str = "customer_state") -> DataFrame:
    """Mean, sample sd and count of ``value`` per ``by``, descending mean."""
    return (df.groupBy(by).agg(
        F.avg(value).alias("avg_ttl"),
        F.stddev_samp(value).alias("sd_ttl"),
        F.count(F.lit(1)).alias("n_ttl"))
        .orderBy(F.desc("avg_ttl")))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Frequency of each non-null value, most frequent first."""
    return (df.where(F.col(col).isNotNull()).groupBy(col)
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col))
