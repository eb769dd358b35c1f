"""Derive the two input tables of the delivery analysis from the TPC-H-ish parquet.

``orders_enriched``: one row per order (the order-level dataset the regression
and classifier work on).  ``order_items``: one row per line item carrying its
order's timeline (the item-level dataset of the timeline audit).

Every derived value uses integer ``%``, ``*`` and ``+`` on keys only, so the
same rules written in SQL give identical rows (the oracle does exactly that).

Plan shape: line items are joined to ``part`` once, then shuffled once by the
order and rolled up.  Orders of many lines take a two-level aggregate instead:
grouping sets over (order, value), then order.  The first level pre-aggregates
map-side, so an order holding a huge share of the line items is already reduced
to its distinct (supplier | part | type) values before any row crosses the
network; the second level keeps O(1) state per order (``min`` of a struct picks
the most frequent value, ties to the smallest).  Dimension tables: nation, customer and supplier are broadcast only
after a count proves them small; otherwise
(customer and supplier at terabyte scale) they join by shuffle, and ``part``
is left to the planner and AQE, which broadcast only when runtime statistics
show it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored_table
from .tables import Tables, sized_broadcast

DAY = 86400
ITEM_STRIDE = 1 << 20  # more lines than an order has


def add_seconds(ts: Column, secs: Column) -> Column:
    return F.timestamp_add("SECOND", secs, ts)


def _items_with_part(t: Tables) -> DataFrame:
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                           "l_extendedprice", "l_tax")
    part = t.part.select("p_partkey", "p_type", "p_size")
    return li.join(part, li.l_partkey == part.p_partkey, "left").drop("p_partkey")


LONG_ORDER = 64  # lines; a longer order's are counted by value before they meet


def order_item_rollup(t: Tables) -> DataFrame:
    """A14: item -> order rollup (counts, totals, most-frequent values).

    The lines of an order meet in one task, once shuffled; orders of more than
    ``LONG_ORDER`` lines are counted in two levels instead.
    """
    items = _items_with_part(t)
    key = F.col("l_orderkey")
    long = stored_table(t.lineitem.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LONG_ORDER)
                        .select(key.alias("_long")), "long-orders")
    if long.isEmpty():
        return _rollup_at_once(items)
    is_long = key.eqNullSafe(F.col("_long"))  # lines without an order are one long order
    return (_rollup_at_once(items.join(long, is_long, "left_anti"))
            .unionByName(_rollup_in_two_levels(items.join(long, is_long, "left_semi"))))


def _rollup_at_once(items: DataFrame) -> DataFrame:
    """The rollup of orders whose lines fit in a list each."""
    def most_frequent(values: str):  # ties -> smallest
        distinct = F.array_distinct(values)
        times = lambda v: F.size(F.filter(values, lambda x: x == v))
        counted = F.array_min(F.transform(distinct, lambda v: F.struct((-times(v)).alias("neg_n"), v.alias("v")))).getField("v")
        # lambdas are interpreted: only orders with a repeated value count
        return F.when(F.size(distinct) == F.size(values), F.array_min(values)).otherwise(counted)

    size = F.col("p_size")
    listed = items.repartition("l_orderkey").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("l_extendedprice").alias("price"),
        F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("freight"),
        F.sum(size).alias("wt"),
        F.sum(size % 9 + 1).alias("len"),
        F.sum(size % 5 + 1).alias("hgt"),
        F.sum(size % 7 + 1).alias("wid"),
        F.sum(size % 6).alias("photos"),
        F.max("l_linenumber").alias("max_line"),
        F.collect_list("l_partkey").alias("parts"),
        F.collect_list("l_suppkey").alias("sellers"),
        F.collect_list("p_type").alias("types"),
    )
    return listed.select(
        "l_orderkey",
        F.col("n").cast("int").alias("nbr_items"),
        F.size(F.array_distinct("parts")).alias("nbr_products"),
        most_frequent("parts").alias("product_key_mfu"),
        F.round("price", 2).alias("ttl_price"),
        F.round("freight", 4).alias("ttl_freight"),
        F.col("wt").cast("double").alias("ttl_wt"),
        F.col("len").cast("double").alias("ttl_length"),
        F.col("hgt").cast("double").alias("ttl_height"),
        F.col("wid").cast("double").alias("ttl_width"),
        F.col("photos").cast("int").alias("nbr_photos"),
        "max_line",
        most_frequent("sellers").alias("seller_key"),
        F.nullif(F.size(F.array_distinct("sellers")), F.lit(0)).alias("nbr_sellers"),
        most_frequent("types").alias("p_type_mfu"),
    )


def _rollup_in_two_levels(items: DataFrame) -> DataFrame:
    """The rollup of orders of any length: grouping sets count the lines by (order, part),
    (order, supplier) and (order, type) together, and a second aggregate per order
    reads each set's rows."""
    in_sets = [["l_orderkey", "l_partkey"], ["l_orderkey", "l_suppkey"], ["l_orderkey", "p_type"]]
    counted = items.groupingSets(in_sets, "l_orderkey", "l_partkey", "l_suppkey", "p_type").agg(
        F.grouping_id().alias("set"),
        F.count(F.lit(1)).alias("n"),
        F.sum("l_extendedprice").alias("price"),
        F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("freight"),
        F.sum("p_size").alias("wt"),
        F.sum(F.col("p_size") % 9 + 1).alias("len"),
        F.sum(F.col("p_size") % 5 + 1).alias("hgt"),
        F.sum(F.col("p_size") % 7 + 1).alias("wid"),
        F.sum(F.col("p_size") % 6).alias("photos"),
        F.max("l_linenumber").alias("max_line"),
    )

    # grouping_id sets a bit for each absent column: part (4), supplier (2), type (1)
    def of(absent: int, value: str):
        return F.when(F.col("set") == absent, F.col(value))

    by_part, by_supplier, by_type = 3, 5, 6

    def most_frequent(absent: int, value: str):  # ties -> smallest
        return F.min(F.when((F.col("set") == absent) & F.col(value).isNotNull(),
                            F.struct((-F.col("n")).alias("neg_n"), F.col(value).alias("v")))).getField("v")

    return counted.groupBy("l_orderkey").agg(
        F.sum(of(by_part, "n")).cast("int").alias("nbr_items"),
        F.count(of(by_part, "l_partkey")).cast("int").alias("nbr_products"),
        most_frequent(by_part, "l_partkey").alias("product_key_mfu"),
        F.round(F.sum(of(by_part, "price")), 2).alias("ttl_price"),
        F.round(F.sum(of(by_part, "freight")), 4).alias("ttl_freight"),
        F.sum(of(by_part, "wt")).cast("double").alias("ttl_wt"),
        F.sum(of(by_part, "len")).cast("double").alias("ttl_length"),
        F.sum(of(by_part, "hgt")).cast("double").alias("ttl_height"),
        F.sum(of(by_part, "wid")).cast("double").alias("ttl_width"),
        F.sum(of(by_part, "photos")).cast("int").alias("nbr_photos"),
        F.max("max_line").alias("max_line"),
        most_frequent(by_supplier, "l_suppkey").alias("seller_key"),
        F.nullif(F.count(of(by_supplier, "l_suppkey")).cast("int"), F.lit(0)).alias("nbr_sellers"),
        most_frequent(by_type, "p_type").alias("p_type_mfu"),
    )


def order_seller_rollup(t: Tables) -> DataFrame:
    """The part of the rollup that an order's timeline depends on: number of lines, highest
    line, most frequent seller.  Needs no product table."""
    lines = t.lineitem.select("l_orderkey", "l_suppkey", "l_linenumber")
    counted = lines.groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_linenumber").alias("max_line"))
    return counted.groupBy("l_orderkey").agg(
        F.sum("n").cast("int").alias("nbr_items"), F.max("max_line").alias("max_line"),
        F.min(F.when(F.col("l_suppkey").isNotNull(), F.struct((-F.col("n")).alias("neg_n"), F.col("l_suppkey").alias("v"))))
        .getField("v").alias("seller_key"))


def _dated(df: DataFrame) -> DataFrame:
    """``df(o_orderkey, o_orderdate, seller_key, c_nationkey, s_nationkey)`` with the dates of each order."""
    k = F.col("o_orderkey")
    pts = add_seconds(F.col("o_orderdate"), k * 7919 % DAY)
    carr = F.when(k % 499 == 0, None).otherwise(add_seconds(
        pts, k * 15485863 % 691200
        + F.when(F.col("seller_key") % 10 == 0, F.lit(259200)).otherwise(F.lit(0))))
    cn = F.col("c_nationkey")
    sn = F.coalesce(F.col("s_nationkey"), F.lit(0))
    delivered = (F.when(k % 37 == 0, None)
                 .when(k % 1009 == 1, add_seconds(F.col("order_delivered_carrier_date"), F.lit(-3600)))
                 .otherwise(add_seconds(
                     F.col("order_delivered_carrier_date"),
                     k * 32452843 % 1209600 + DAY * ((cn + sn) % 4)
                     + F.when(cn % 7 == 0, F.lit(259200)).otherwise(F.lit(0)))))
    purchased = F.col("order_purchase_timestamp")
    return (df.withColumn("order_purchase_timestamp", pts)
            .withColumn("order_delivered_carrier_date", carr)
            .withColumn("order_delivered_customer_date", delivered)
            .withColumn("order_approved_at", F.when(k % 997 == 0, None).otherwise(add_seconds(purchased, k * 104729 % 259200)))
            # day start without a time zone: NTZ -> date -> NTZ midnight (date_trunc would
            # return a zone-aware timestamp and depend on the session time zone)
            .withColumn("order_estimated_delivery_date",
                        add_seconds(F.to_date(purchased).cast("timestamp_ntz"), DAY * (16 + k * 613 % 15)))
            .withColumn("ship_limit_final", add_seconds(purchased, DAY * (4 + k * 31 % 5))))


TIMELINE = ["order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date",
            "order_estimated_delivery_date"]


def item_timeline(t: Tables) -> DataFrame:
    """One row per line item with its order's dates and nothing else of the order: for the
    audits that read dates only.  Products and places are not joined."""
    cust = sized_broadcast(t.customer.select("c_custkey", "c_nationkey"), DIM_BROADCAST_ROWS)
    supp = sized_broadcast(t.supplier.select("s_suppkey", "s_nationkey"), DIM_BROADCAST_ROWS)
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    orders = _dated(o.join(order_seller_rollup(t), o.o_orderkey == F.col("l_orderkey"), "left")
                    .join(cust, o.o_custkey == cust.c_custkey, "left")
                    .join(supp, F.col("seller_key") == supp.s_suppkey, "left"))
    orders = orders.select("o_orderkey", "max_line", "ship_limit_final", *TIMELINE)
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return li.join(orders, li.l_orderkey == orders.o_orderkey, "inner").select(
        F.col("o_orderkey").cast("string").alias("order_id"), F.col("l_linenumber").alias("order_item_id"), *TIMELINE,
        _item_limit().alias("shipping_limit_date"), F.col("l_suppkey").cast("string").alias("seller_id"),
        F.col("l_partkey").cast("string").alias("product_id"))


def _item_limit() -> Column:
    """Shipping limit of a line: the order's for its last line, a day less for the others."""
    last = F.col("l_linenumber") == F.col("max_line")
    return F.when(last, F.col("ship_limit_final")).otherwise(add_seconds(F.col("ship_limit_final"), F.lit(-DAY)))


def _place_columns(key: Column, nation_name: Column, nationkey: Column, prefix: str) -> list[Column]:
    return [
        F.concat(nation_name, F.lit("_C"), (key % 7).cast("string")).alias(f"{prefix}_city"),
        nation_name.alias(f"{prefix}_state"),
        F.lpad((nationkey * 1000 + key % 20).cast("string"), 5, "0").alias(f"{prefix}_zip_code_prefix"),
    ]


# customer / supplier dimension rows broadcast when a count proves
# them within this many rows; larger dimensions join by shuffle
DIM_BROADCAST_ROWS = 500_000


def orders_enriched(t: Tables) -> DataFrame:
    """One row per order with the reference's order-level columns."""
    return _orders(t).drop("max_line")


def _orders(t: Tables) -> DataFrame:
    """orders_enriched plus the order's highest line number (for the item table)."""
    cust = sized_broadcast(t.customer.select("c_custkey", "c_nationkey"), DIM_BROADCAST_ROWS)
    supp = sized_broadcast(t.supplier.select("s_suppkey", "s_nationkey"), DIM_BROADCAST_ROWS)
    nation = sized_broadcast(t.nation.select("n_nationkey", "n_name"), 10_000)
    c_nation = nation.select(F.col("n_nationkey").alias("c_place"), F.col("n_name").alias("c_name"))
    s_nation = nation.select(F.col("n_nationkey").alias("s_place"), F.col("n_name").alias("s_name"))

    # keys travel; the places' names and coordinates are written out after the last shuffle
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    o = o.join(cust, o.o_custkey == cust.c_custkey, "left")
    df = (o.join(order_item_rollup(t), o.o_orderkey == F.col("l_orderkey"), "left")
          .join(supp, F.col("seller_key") == supp.s_suppkey, "left")
          .join(c_nation, F.col("c_nationkey") == F.col("c_place"), "left")
          .join(s_nation, F.col("s_nationkey") == F.col("s_place"), "left"))
    ck, cn, sn = F.col("c_custkey"), F.col("c_nationkey"), F.col("s_nationkey")

    df = _dated(df)
    k, slf = F.col("o_orderkey"), F.col("ship_limit_final")
    deliv = F.col("order_delivered_customer_date")
    return df.select(
        k.alias("Rww_ID"),
        k.cast("string").alias("order_id"),
        F.when(deliv.isNotNull(), F.lit("delivered")).otherwise(F.lit("shipped")).alias("order_status"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("o_custkey").cast("string").alias("customer_unique_id"),
        *TIMELINE,
        F.when(F.col("nbr_items") > 1, add_seconds(slf, F.lit(-DAY))).otherwise(slf).alias("ship_limit_initial"),
        "ship_limit_final",
        add_seconds(deliv, F.lit(DAY)).alias("earliest_review_dt"),
        add_seconds(deliv, F.lit(3 * DAY)).alias("latest_review_dt"),
        *_place_columns(ck, F.col("c_name"), cn, "customer"),
        F.col("seller_key").cast("string").alias("seller_id"),
        *_place_columns(F.col("s_suppkey"), F.col("s_name"), sn, "seller"),
        F.col("product_key_mfu").cast("string").alias("product_id_mfu"),
        F.when(k % 71 == 0, None).otherwise(F.col("p_type_mfu")).alias("product_ctgry_mfu"),
        F.col("o_orderpriority").alias("payment_type_mfu"),
        F.when(k % 1999 == 0, None).otherwise(F.round(F.col("ttl_price") + F.col("ttl_freight"), 4)).alias("ttl_pd"),
        "ttl_price", "ttl_freight", "ttl_wt", "ttl_length", "ttl_height", "ttl_width",
        "nbr_items", "nbr_sellers", "nbr_products", "nbr_photos",
        (1 + k % 2).cast("int").alias("pmt_mthds_used"),
        (1 + k % 10).cast("int").alias("installments_used_ttl"),
        (1 + k % 2).cast("int").alias("payment_types_used"),
        F.when(deliv.isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("int").alias("nbr_rws"),
        (1 + k * 7 % 5).cast("double").alias("avg_score"),
        F.when(ck % 53 == 0, None).when(ck % 211 == 0, F.lit(40.0))
        .otherwise(F.lit(-33.0) + (cn * 37) % 38 + (ck % 100) / 200.0).alias("lat_customer"),
        F.when(ck % 53 == 0, None).otherwise(F.lit(-73.0) + (cn * 53) % 38).alias("long_customer"),
        (F.lit(-33.0) + (sn * 37) % 38).alias("lat_seller"),
        (F.lit(-73.0) + (sn * 53) % 38).alias("long_seller"),
        "max_line",
    )


def order_items(t: Tables) -> DataFrame:
    """One row per line item, carrying its order's timeline (item-level table)."""
    nation = sized_broadcast(t.nation.select("n_nationkey", "n_name"), 10_000)
    oe = _orders(t)
    supp = t.supplier.select("s_suppkey", "s_nationkey")
    supp = supp.join(nation, supp.s_nationkey == nation.n_nationkey, "left").select(
        "s_suppkey", F.col("n_name").alias("item_seller_state"),
        (F.lit(-33.0) + (F.col("s_nationkey") * 37) % 38).alias("item_lat_seller"),
        (F.lit(-73.0) + (F.col("s_nationkey") * 53) % 38).alias("item_long_seller"))
    supp = sized_broadcast(supp, DIM_BROADCAST_ROWS)
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                           "l_extendedprice", "l_tax")
    part = t.part.select("p_partkey", "p_type", "p_size")
    items = (li.join(part, li.l_partkey == part.p_partkey, "left")
             .join(supp, li.l_suppkey == supp.s_suppkey, "left"))
    df = items.join(oe, items.l_orderkey == oe.Rww_ID, "inner")
    k = F.col("Rww_ID")
    return df.select(
        # the order's key and the line's number in it: the same in every run
        (k * ITEM_STRIDE + F.col("l_linenumber")).alias("Rww_ID"),
        "order_id",
        F.col("l_linenumber").alias("order_item_id"),
        "order_status", "customer_id",
        "order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
        "order_delivered_customer_date", "order_estimated_delivery_date",
        _item_limit().alias("shipping_limit_date"),
        F.col("item_lat_seller").alias("lat_seller"),
        F.col("item_long_seller").alias("long_seller"),
        "lat_customer", "long_customer",
        F.col("item_seller_state").alias("seller_state"),
        "customer_state", "customer_city", "customer_zip_code_prefix",
        F.col("l_suppkey").cast("string").alias("seller_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.when(k % 71 == 0, None).otherwise(F.col("p_type")).alias("product_category_name_english"),
        F.lit(1).alias("payment_sequential"),
        (1 + k % 10).cast("int").alias("payment_installments"),
        F.col("ttl_pd").alias("payment_value"),
        F.col("l_extendedprice").alias("price"),
        F.round(F.col("l_extendedprice") * F.col("l_tax"), 4).alias("freight_value"),
        F.col("p_size").alias("product_name_lenght"),
        (F.col("p_size") * 7 % 50).alias("product_description_lenght"),
        (1 + k * 7 % 5).cast("int").alias("review_score"),
    )
