"""Registry of named queries (one per operator of the blueprint) and their
oracle SQL.

Every query takes (spark, sf_dir), reads the base tables under ``sf_dir``
and returns a lazy DataFrame over the whole tables.  Computed doubles are
rounded to 6 decimals in both engines so order-of-summation noise does not
decide a value comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as O
from .functions import geo
from .operators import audit, rollups
from .plans import datasets as ds
from .sources import fixtures
from .sources.tables import load_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _rounded(c, scale: float):
    """floor(x * scale + 0.5) / scale: the same IEEE steps in Spark and in the
    oracle SQL, so ties round identically in both.  From 2**52 / scale on a double
    has no such decimals left (and floor would pass through bigint): unchanged."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.abs(c) < 2.0 ** 52 / scale, F.floor(c * scale + 0.5) / scale).otherwise(c)


def round6(c):
    """Round to 6 decimals."""
    return _rounded(c, 1000000.0)


def r6(c: str, alias: str | None = None):
    return round6(c).alias(alias or c)


def r9(c: str, alias: str | None = None):
    """9-decimal rounding for means of exact day fractions, whose 6-decimal
    ties are frequent (a mean of k/86400 values often ends in ...5 at the
    7th decimal, where 1-ulp summation noise would decide the rounding)."""
    return _rounded(c, 1e9).alias(alias or c)


def s6(c: str, alias: str | None = None) -> str:
    return f"round({c}, 6) AS {alias or c}"


# --- 1. scans, derived tables ------------------------------------------------

@register("order_rollup", O.sql("SELECT * FROM oe"))
def q_order_rollup(spark, sf):
    """A14: item -> order rollup producing the order-level table."""
    return ds.orders(spark, sf)


@register("build_order_items", O.sql("SELECT * FROM oi", items=True))
def q_build_order_items(spark, sf):
    """J6: line items joined to their order, customer, seller and product."""
    return fixtures.order_items(load_tables(spark, sf)).drop("Rww_ID")


# --- 2. timeline audit & features ------------------------------------------

@register("chronology_violations", O.on_items(f"""
SELECT rule, n_rows FROM (
  SELECT 'purchase_after_approval' AS rule, CAST(count(*) FILTER (WHERE {O.PTS} > {O.APPR}) AS BIGINT) AS n_rows FROM oif
  UNION ALL SELECT 'approval_after_carrier', CAST(count(*) FILTER (WHERE {O.APPR} > {O.CARR}) AS BIGINT) FROM oif
  UNION ALL SELECT 'purchase_after_carrier', CAST(count(*) FILTER (WHERE {O.PTS} > {O.CARR}) AS BIGINT) FROM oif
  UNION ALL SELECT 'carrier_not_before_customer', CAST(count(*) FILTER (WHERE {O.CARR} >= {O.DELIV}) AS BIGINT) FROM oif
  UNION ALL SELECT 'approval_after_customer', CAST(count(*) FILTER (WHERE {O.APPR} > {O.DELIV}) AS BIGINT) FROM oif
  UNION ALL SELECT 'purchase_after_customer', CAST(count(*) FILTER (WHERE {O.PTS} > {O.DELIV}) AS BIGINT) FROM oif)
"""))
def q_chronology(spark, sf):
    return audit.chronology_violations(ds.timeline_items(spark, sf))


_CLEAN_COLS = ["order_id", "order_item_id", "seller_id", "product_id", O.PTS, O.APPR, O.CARR, O.DELIV, O.EST]


@register("clean_timeline", O.on_items(f"SELECT {', '.join(_CLEAN_COLS)} FROM ci"))
def q_clean_timeline(spark, sf):
    return ds.clean_timeline_items(spark, sf).select(*_CLEAN_COLS)


@register("suspect_approvals", O.on_items(f"""
SELECT CAST(({O.APPR} > {O.DELIV} OR {O.APPR} > {O.CARR}) AS INTEGER) AS approval_suspect,
       count(*) AS n_rows, CAST(sum({O.flag(f"{O.DELIV} > {O.EST}")}) AS BIGINT) AS n_late
FROM oif WHERE {O.DELIV} IS NOT NULL AND {O.CARR} IS NOT NULL AND {O.CARR} <= {O.DELIV} AND {O.APPR} IS NOT NULL
GROUP BY 1
"""))
def q_suspect_approvals(spark, sf):
    return audit.suspect_approvals(ds.timeline_items(spark, sf))


def _null_census_sql(table: str, cols: list[str]) -> str:
    parts = [f"SELECT '{c}' AS column_name, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_null FROM {table}"
             for c in cols]
    return "SELECT * FROM (" + "\nUNION ALL ".join(parts) + ") WHERE n_null > 0"


_OE_COLS = ["Rww_ID", "order_id", "order_status", "customer_id", "customer_unique_id", O.PTS, O.APPR, O.CARR,
            O.DELIV, O.EST, "ship_limit_initial", O.SLF, "earliest_review_dt", "latest_review_dt",
            "customer_city", "customer_state", "customer_zip_code_prefix", "seller_id", "seller_city",
            "seller_state", "seller_zip_code_prefix", "product_id_mfu", "product_ctgry_mfu", "payment_type_mfu",
            "ttl_pd", "ttl_price", "ttl_freight", "ttl_wt", "ttl_length", "ttl_height", "ttl_width",
            "nbr_items", "nbr_sellers", "nbr_products", "nbr_photos", "pmt_mthds_used", "installments_used_ttl",
            "payment_types_used", "nbr_rws", "avg_score", "lat_customer", "long_customer", "lat_seller",
            "long_seller"]
_FEAT_COLS = _OE_COLS + ["fulfill_duration", "late_delivery_flag", "est_delivery_time_days", "approval_time_days",
                         "shipping_limit_missed", "shipping_limit_miss_amt", "days_remaining", "distance_km",
                         "states_same_or_diff", "state_pair", "purchase_mo", "purchase_mo_name",
                         "purchase_yr_and_mo", "purchase_yr_frac", "purchase_day_of_wk", "purchase_day_name",
                         "est_delivery_mo", "est_delivery_mo_name", "est_delivery_yr_frac", "est_delivery_day_name"]


@register("null_census", O.on_features(_null_census_sql("feat", _FEAT_COLS)))
def q_null_census(spark, sf):
    return audit.null_census(ds.order_features(spark, sf))


# the order table's schema contract (column -> Spark type name)
_OE_TYPES = {c: "string" for c in _OE_COLS}
_OE_TYPES.update({c: "timestamp_ntz" for c in [O.PTS, O.APPR, O.CARR, O.DELIV, O.EST, "ship_limit_initial",
                                                O.SLF, "earliest_review_dt", "latest_review_dt"]})
_OE_TYPES.update({c: "double" for c in ["ttl_pd", "ttl_price", "ttl_freight", "ttl_wt", "ttl_length", "ttl_height",
                                        "ttl_width", "avg_score", "lat_customer", "long_customer", "lat_seller",
                                        "long_seller"]})
_OE_TYPES.update({c: "int" for c in ["nbr_items", "nbr_sellers", "nbr_products", "nbr_photos", "pmt_mthds_used",
                                     "installments_used_ttl", "payment_types_used", "nbr_rws"]})
_OE_TYPES["Rww_ID"] = "bigint"


@register("profile_columns", O.sql(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS data_type, count({c}) AS non_null FROM oe" for c, t in _OE_TYPES.items())))
def q_profile_columns(spark, sf):
    return audit.profile_columns(ds.orders(spark, sf))


_CC_OUT = ["Rww_ID", O.PTS, O.DELIV, "ttl_pd", "nbr_items"]


@register("complete_cases_reg", O.on_features(f"SELECT {', '.join(_CC_OUT)}, {s6('distance_km')} FROM reg_cc"))
def q_cc_reg(spark, sf):
    return ds.reg_frame(spark, sf).select(*_CC_OUT, r6("distance_km"))


@register("complete_cases_clf", O.on_features(f"SELECT {', '.join(_CC_OUT)}, {s6('days_remaining')} FROM clf_cc"))
def q_cc_clf(spark, sf):
    return ds.clf_frame(spark, sf).select(*_CC_OUT, r6("days_remaining"))


@register("delivery_durations", O.on_items(
    "SELECT order_id, order_item_id, delivery_hours, carrier_to_customer_hours, order_to_carrier_hours FROM oif"))
def q_delivery_durations(spark, sf):
    return ds.timeline_items(spark, sf).select("order_id", "order_item_id", "delivery_hours",
                                      "carrier_to_customer_hours", "order_to_carrier_hours")


@register("late_flag", O.on_features(f"""
SELECT Rww_ID, late_delivery_flag,
       {O.flag(f"{O.DELIV} > {O.EST} + INTERVAL 1 DAY")} AS late_flag_grace_strict,
       {O.flag(f"{O.DELIV} > {O.EST}")} AS late_flag_strict
FROM feat"""))
def q_late_flag(spark, sf):
    from .functions import timing
    f = ds.order_features(spark, sf)
    return f.select("Rww_ID", "late_delivery_flag",
                    timing.late_flag(O.DELIV, O.EST, "grace_strict").alias("late_flag_grace_strict"),
                    timing.late_flag(O.DELIV, O.EST, "strict").alias("late_flag_strict"))


@register("timing_features", O.on_features(
    "SELECT Rww_ID, est_delivery_time_days, approval_time_days, fulfill_duration FROM feat"))
def q_timing_features(spark, sf):
    return ds.order_features(spark, sf).select("Rww_ID", "est_delivery_time_days", "approval_time_days",
                                               "fulfill_duration")


@register("shipping_limit_features", O.on_features(
    "SELECT Rww_ID, shipping_limit_missed, shipping_limit_miss_amt FROM feat"))
def q_shipping_limit_features(spark, sf):
    return ds.order_features(spark, sf).select("Rww_ID", "shipping_limit_missed", "shipping_limit_miss_amt")


@register("days_remaining", O.on_features("SELECT Rww_ID, days_remaining FROM feat"))
def q_days_remaining(spark, sf):
    return ds.order_features(spark, sf).select("Rww_ID", "days_remaining")


@register("geo_pair_features", O.on_features("SELECT Rww_ID, state_pair, states_same_or_diff FROM feat"))
def q_geo_pair(spark, sf):
    return ds.order_features(spark, sf).select("Rww_ID", "state_pair", "states_same_or_diff")


_CAL = ["purchase_mo", "purchase_mo_name", "purchase_yr_and_mo", "purchase_day_of_wk", "purchase_day_name",
        "est_delivery_mo", "est_delivery_mo_name", "est_delivery_day_name"]


@register("calendar_features", O.on_features(
    f"SELECT Rww_ID, {', '.join(_CAL)}, purchase_yr_frac, est_delivery_yr_frac FROM feat"))
def q_calendar(spark, sf):
    return ds.order_features(spark, sf).select("Rww_ID", *_CAL, "purchase_yr_frac", "est_delivery_yr_frac")


# states flagged by the state-indicator operator (parameter of the query)
FLAG_STATES = ["NATION_0", "NATION_1", "NATION_2", "NATION_3"]


@register("state_flags", O.on_features(
    "SELECT Rww_ID, " + ", ".join(f"{O.flag(f'customer_state = {chr(39)}{s}{chr(39)}')} AS Cust_st_{s}"
                                  for s in FLAG_STATES) + " FROM feat"))
def q_state_flags(spark, sf):
    f = ds.order_features(spark, sf)
    return f.select("Rww_ID", *[geo.state_flag("customer_state", s).alias(f"Cust_st_{s}") for s in FLAG_STATES])


@register("distance_km", O.on_features(f"SELECT Rww_ID, {s6('distance_km')} FROM feat"))
def q_distance(spark, sf):
    return ds.order_features(spark, sf).select("Rww_ID", r6("distance_km"))


@register("geo_outlier_mask", O.on_items(
    f"SELECT order_id, order_item_id, lat_customer, long_customer, {s6('distance_km')} FROM oif"))
def q_geo_mask(spark, sf):
    return ds.items(spark, sf).select("order_id", "order_item_id", "lat_customer", "long_customer",
                                      r6("distance_km"))


# --- 3. flagship slice & rollups ---------------------------------------------

_SLO = f"""
slo AS (
  SELECT order_id, max(shipping_limit_date) AS max_shipping_limit, max({O.CARR}) AS delivered_to_carrier_dt,
         max({O.DELIV}) AS delivered_to_cust_dt, max({O.EST}) AS est_cust_delivery_dt
  FROM ci GROUP BY order_id
),
slf_orders AS (
  SELECT *, {O.flag("delivered_to_carrier_dt > max_shipping_limit")} AS shipping_limit_problem_flag,
         {O.flag("delivered_to_cust_dt > est_cust_delivery_dt + INTERVAL 1 DAY")} AS late_delivery_flag
  FROM slo
)"""


@register("shipping_limit_orders", O.on_items("SELECT * FROM slf_orders", _SLO))
def q_shipping_limit_orders(spark, sf):
    return rollups.shipping_limit_orders(ds.clean_timeline_items(spark, sf))


CONDITIONAL_LATE_RATES_SQL = O.on_items(f"""
SELECT shipping_limit_problem_flag, count(*) AS n_orders, CAST(sum(late_delivery_flag) AS BIGINT) AS n_late,
       {O.rate('sum(late_delivery_flag)', 'count(*)')} AS pct_late
FROM slf_orders GROUP BY shipping_limit_problem_flag""", _SLO)


def conditional_late_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: does missing the shipping limit raise the odds of a late delivery?"""
    orders = rollups.shipping_limit_orders(ds.clean_timeline_items(spark, sf))
    out = rollups.conditional_late_rates(orders, "shipping_limit_problem_flag")
    return out.withColumn("pct_late", round6("pct_late"))


register("conditional_late_rates", CONDITIONAL_LATE_RATES_SQL)(conditional_late_rates)

_OTR = f"""
otr0 AS (
  SELECT order_id, CAST(count(*) AS INTEGER) AS nbr_items, max({O.PTS}) AS purchase_dt, max({O.APPR}) AS approval_dt,
         max({O.CARR}) AS delivered_to_carrier_dt, max({O.DELIV}) AS delivered_to_cust_dt,
         max({O.EST}) AS est_cust_delivery_dt
  FROM ci GROUP BY order_id
),
otr AS (
  SELECT *, {O.days('purchase_dt', 'approval_dt')} AS approval_time,
         {O.flag("delivered_to_cust_dt > est_cust_delivery_dt + INTERVAL 1 DAY")} AS late_delivery_flag,
         {O.days('purchase_dt', 'est_cust_delivery_dt')} AS est_time
  FROM otr0
)"""


def _timing_rollup(spark, sf):
    return rollups.order_timing_rollup(ds.clean_timeline_items(spark, sf))


@register("order_timing_rollup", O.on_items("SELECT * FROM otr", _OTR))
def q_order_timing(spark, sf):
    return _timing_rollup(spark, sf)


@register("conditional_late_rates_approval", O.on_items(f"""
SELECT CAST(approval_time > 1 AS INTEGER) AS slow_approval, count(*) AS n_orders,
       CAST(sum(late_delivery_flag) AS BIGINT) AS n_late, {O.rate('sum(late_delivery_flag)', 'count(*)')} AS pct_late
FROM otr GROUP BY 1""", _OTR))
def q_clr_approval(spark, sf):
    out = rollups.conditional_late_rates(_timing_rollup(spark, sf),
                                         (F.col("approval_time") > 1).cast("int"), "slow_approval")
    return out.withColumn("pct_late", round6("pct_late"))


@register("late_rate_by_items", O.on_items(f"""
SELECT nbr_items, count(*) AS ttl_orders, CAST(sum(late_delivery_flag) AS BIGINT) AS orders_late,
       {O.rate('sum(late_delivery_flag)', 'count(*)')} AS pct_late
FROM otr GROUP BY nbr_items""", _OTR))
def q_late_by_items(spark, sf):
    out = rollups.late_rate_by(_timing_rollup(spark, sf), "nbr_items", "nbr_items")
    return out.withColumn("pct_late", round6("pct_late"))


@register("late_rate_by_est_days", O.on_items(f"""
SELECT CAST(ceil(est_time) AS BIGINT) AS est_time_daybuckets, count(*) AS ttl_orders,
       CAST(sum(late_delivery_flag) AS BIGINT) AS orders_late, {O.rate('sum(late_delivery_flag)', 'count(*)')} AS pct_late
FROM otr GROUP BY 1""", _OTR))
def q_late_by_est(spark, sf):
    out = rollups.late_rate_by(_timing_rollup(spark, sf), F.ceil("est_time"), "est_time_daybuckets")
    return out.withColumn("pct_late", round6("pct_late"))


@register("ecdf_at", O.on_items(f"""
SELECT count(*) FILTER (WHERE approval_time <= 1) AS n_at_or_below, count(approval_time) AS n,
       {O.rate('count(*) FILTER (WHERE approval_time <= 1)', 'count(approval_time)')} AS ecdf
FROM otr""", _OTR))
def q_ecdf(spark, sf):
    return rollups.ecdf_at(_timing_rollup(spark, sf), "approval_time", 1.0).withColumn("ecdf", round6("ecdf"))


@register("late_distinct_orders", O.on_items(
    "SELECT count(*) AS late_items, count(DISTINCT order_id) AS late_orders FROM ci WHERE late_flag = 1"))
def q_late_distinct(spark, sf):
    return rollups.late_distinct_orders(ds.clean_timeline_items(spark, sf))


@register("split_delivery_orders", O.on_items(f"""
SELECT order_id, min({O.DELIV}) AS min_delivery_dt, max({O.DELIV}) AS max_delivery_dt FROM ci
GROUP BY order_id HAVING min({O.DELIV}) <> max({O.DELIV})"""))
def q_split_delivery(spark, sf):
    return rollups.split_delivery_orders(ds.clean_timeline_items(spark, sf))


@register("count_by_category", O.on_items(
    "SELECT product_category_name_english, count(*) AS n FROM ci GROUP BY product_category_name_english"))
def q_count_by_category(spark, sf):
    return rollups.count_by_category(ds.clean_items(spark, sf), "product_category_name_english")


for _col in ("seller_state", "customer_state", "order_status"):
    def _q_count_by(spark, sf, col=_col):
        """A1: item counts by one more column."""
        return rollups.count_by_category(ds.clean_items(spark, sf), col)

    register(f"count_by_{_col}", O.on_items(f"SELECT {_col}, count(*) AS n FROM ci GROUP BY {_col}"))(_q_count_by)


@register("delivery_stats_by_state", O.on_items(
    "SELECT customer_state, round(avg(delivery_hours), 6) AS avg_ttl, round(stddev_samp(delivery_hours), 6) AS sd_ttl, "
    "count(*) AS n_ttl FROM ci GROUP BY customer_state"))
def q_delivery_stats(spark, sf):
    out = rollups.delivery_stats_by_state(ds.clean_items(spark, sf))
    return out.select("customer_state", r6("avg_ttl"), r6("sd_ttl"), "n_ttl")


# further query groups register themselves on import
from . import catalog_decisions, catalog_levels, catalog_models, catalog_prep, catalog_profile, catalog_sources  # noqa: E402,F401,I001
