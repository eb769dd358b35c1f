"""Equivalent ANSI SQL (DuckDB dialect) for every registered query.

Each statement rebuilds the derived tables from the base views
(``orders lineitem part customer supplier nation``) with the same integer
rules as ``sources.fixtures``, then applies the operator.  The CTEs are
composed from named fragments so the statements stay readable.
"""

from __future__ import annotations

# --- derived tables -------------------------------------------------------

_ITEMS = """
items AS (
  SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_extendedprice, l.l_tax,
         p.p_type, p.p_size
  FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey
),
per_part AS (
  SELECT l_orderkey, l_partkey, count(*) AS n, sum(l_extendedprice) AS price,
         sum(l_extendedprice * l_tax) AS freight, sum(p_size) AS wt, sum(p_size % 9 + 1) AS len,
         sum(p_size % 5 + 1) AS hgt, sum(p_size % 7 + 1) AS wid, sum(p_size % 6) AS photos,
         max(l_linenumber) AS max_line
  FROM items GROUP BY l_orderkey, l_partkey
),
by_order AS (
  SELECT l_orderkey, CAST(sum(n) AS INTEGER) AS nbr_items, CAST(count(l_partkey) AS INTEGER) AS nbr_products,
         arg_min(l_partkey, (-n, l_partkey)) FILTER (WHERE l_partkey IS NOT NULL) AS product_key_mfu,
         round(sum(price), 2) AS ttl_price, round(sum(freight), 4) AS ttl_freight,
         CAST(sum(wt) AS DOUBLE) AS ttl_wt, CAST(sum(len) AS DOUBLE) AS ttl_length,
         CAST(sum(hgt) AS DOUBLE) AS ttl_height, CAST(sum(wid) AS DOUBLE) AS ttl_width,
         CAST(sum(photos) AS INTEGER) AS nbr_photos, max(max_line) AS max_line
  FROM per_part GROUP BY l_orderkey
),
per_supp AS (
  SELECT l_orderkey, l_suppkey, count(*) AS n FROM items WHERE l_suppkey IS NOT NULL
  GROUP BY l_orderkey, l_suppkey
),
sellers AS (
  SELECT l_orderkey, arg_min(l_suppkey, (-n, l_suppkey)) AS seller_key,
         CAST(count(*) AS INTEGER) AS nbr_sellers
  FROM per_supp GROUP BY l_orderkey
),
per_type AS (
  SELECT l_orderkey, p_type, count(*) AS n FROM items WHERE p_type IS NOT NULL
  GROUP BY l_orderkey, p_type
),
types AS (
  SELECT l_orderkey, arg_min(p_type, (-n, p_type)) AS p_type_mfu FROM per_type GROUP BY l_orderkey
),
cust AS (
  SELECT c.c_custkey, c.c_nationkey, n.n_name AS customer_state,
         n.n_name || '_C' || CAST(c.c_custkey % 7 AS VARCHAR) AS customer_city,
         lpad(CAST(c.c_nationkey * 1000 + c.c_custkey % 20 AS VARCHAR), 5, '0') AS customer_zip_code_prefix,
         CASE WHEN c.c_custkey % 53 = 0 THEN NULL WHEN c.c_custkey % 211 = 0 THEN 40.0
              ELSE -33.0 + (c.c_nationkey * 37) % 38 + (c.c_custkey % 100) / 200.0 END::DOUBLE AS lat_customer,
         CASE WHEN c.c_custkey % 53 = 0 THEN NULL ELSE -73.0 + (c.c_nationkey * 53) % 38 END::DOUBLE AS long_customer
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
),
supp AS (
  SELECT s.s_suppkey, s.s_nationkey, n.n_name AS seller_state,
         n.n_name || '_C' || CAST(s.s_suppkey % 7 AS VARCHAR) AS seller_city,
         lpad(CAST(s.s_nationkey * 1000 + s.s_suppkey % 20 AS VARCHAR), 5, '0') AS seller_zip_code_prefix,
         (-33.0 + (s.s_nationkey * 37) % 38)::DOUBLE AS lat_seller,
         (-73.0 + (s.s_nationkey * 53) % 38)::DOUBLE AS long_seller
  FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
),
base AS (
  SELECT o.o_orderkey AS k, o.o_custkey, o.o_orderpriority,
         o.o_orderdate + to_seconds(o.o_orderkey * 7919 % 86400) AS pts,
         b.*, s.seller_key, s.nbr_sellers, t.p_type_mfu,
         c.c_nationkey, c.customer_state, c.customer_city, c.customer_zip_code_prefix, c.lat_customer, c.long_customer,
         sp.s_nationkey, sp.seller_state, sp.seller_city, sp.seller_zip_code_prefix, sp.lat_seller, sp.long_seller
  FROM orders o
  LEFT JOIN by_order b ON o.o_orderkey = b.l_orderkey
  LEFT JOIN sellers s ON o.o_orderkey = s.l_orderkey
  LEFT JOIN types t ON o.o_orderkey = t.l_orderkey
  LEFT JOIN cust c ON o.o_custkey = c.c_custkey
  LEFT JOIN supp sp ON s.seller_key = sp.s_suppkey
),
base2 AS (
  SELECT *,
         CASE WHEN k % 499 = 0 THEN NULL
              ELSE pts + to_seconds(k * 15485863 % 691200 + CASE WHEN seller_key % 10 = 0 THEN 259200 ELSE 0 END)
         END AS carr,
         pts + to_seconds(86400 * (4 + k * 31 % 5)) AS slf
  FROM base
),
base3 AS (
  SELECT *,
         CASE WHEN k % 37 = 0 THEN NULL
              WHEN k % 1009 = 1 THEN carr + to_seconds(-3600)
              ELSE carr + to_seconds(k * 32452843 % 1209600 + 86400 * ((c_nationkey + coalesce(s_nationkey, 0)) % 4)
                                     + CASE WHEN c_nationkey % 7 = 0 THEN 259200 ELSE 0 END)
         END AS deliv
  FROM base2
),
oe AS (
  SELECT k AS Rww_ID, CAST(k AS VARCHAR) AS order_id,
         CASE WHEN deliv IS NOT NULL THEN 'delivered' ELSE 'shipped' END AS order_status,
         CAST(o_custkey AS VARCHAR) AS customer_id, CAST(o_custkey AS VARCHAR) AS customer_unique_id,
         pts AS order_purchase_timestamp,
         CASE WHEN k % 997 = 0 THEN NULL ELSE pts + to_seconds(k * 104729 % 259200) END AS order_approved_at,
         carr AS order_delivered_carrier_date,
         deliv AS order_delivered_customer_date,
         date_trunc('day', pts) + to_seconds(86400 * (16 + k * 613 % 15)) AS order_estimated_delivery_date,
         CASE WHEN nbr_items > 1 THEN slf + to_seconds(-86400) ELSE slf END AS ship_limit_initial,
         slf AS ship_limit_final,
         deliv + to_seconds(86400) AS earliest_review_dt,
         deliv + to_seconds(3 * 86400) AS latest_review_dt,
         customer_city, customer_state, customer_zip_code_prefix,
         CAST(seller_key AS VARCHAR) AS seller_id, seller_city, seller_state, seller_zip_code_prefix,
         CAST(product_key_mfu AS VARCHAR) AS product_id_mfu,
         CASE WHEN k % 71 = 0 THEN NULL ELSE p_type_mfu END AS product_ctgry_mfu,
         o_orderpriority AS payment_type_mfu,
         CASE WHEN k % 1999 = 0 THEN NULL ELSE round(ttl_price + ttl_freight, 4) END AS ttl_pd,
         ttl_price, ttl_freight, ttl_wt, ttl_length, ttl_height, ttl_width,
         nbr_items, nbr_sellers, nbr_products, nbr_photos,
         CAST(1 + k % 2 AS INTEGER) AS pmt_mthds_used,
         CAST(1 + k % 10 AS INTEGER) AS installments_used_ttl,
         CAST(1 + k % 2 AS INTEGER) AS payment_types_used,
         CAST(CASE WHEN deliv IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS nbr_rws,
         CAST(1 + k * 7 % 5 AS DOUBLE) AS avg_score,
         lat_customer, long_customer, lat_seller, long_seller
  FROM base3
)"""

_ORDER_ITEMS = """
oi AS (
  SELECT oe.order_id, i.l_linenumber AS order_item_id, oe.order_status, oe.customer_id,
         oe.order_purchase_timestamp, oe.order_approved_at, oe.order_delivered_carrier_date,
         oe.order_delivered_customer_date, oe.order_estimated_delivery_date,
         CASE WHEN i.l_linenumber = m.max_line THEN oe.ship_limit_final
              ELSE oe.ship_limit_final + to_seconds(-86400) END AS shipping_limit_date,
         (-33.0 + (sp.s_nationkey * 37) % 38)::DOUBLE AS lat_seller,
         (-73.0 + (sp.s_nationkey * 53) % 38)::DOUBLE AS long_seller,
         oe.lat_customer, oe.long_customer, sp.seller_state, oe.customer_state, oe.customer_city,
         oe.customer_zip_code_prefix, CAST(i.l_suppkey AS VARCHAR) AS seller_id,
         CAST(i.l_partkey AS VARCHAR) AS product_id,
         CASE WHEN oe.Rww_ID % 71 = 0 THEN NULL ELSE i.p_type END AS product_category_name_english,
         1 AS payment_sequential, CAST(1 + oe.Rww_ID % 10 AS INTEGER) AS payment_installments,
         oe.ttl_pd AS payment_value, i.l_extendedprice AS price,
         round(i.l_extendedprice * i.l_tax, 4) AS freight_value,
         i.p_size AS product_name_lenght, i.p_size * 7 % 50 AS product_description_lenght,
         CAST(1 + oe.Rww_ID * 7 % 5 AS INTEGER) AS review_score
  FROM items i
  JOIN (SELECT l_orderkey, max(l_linenumber) AS max_line FROM lineitem GROUP BY l_orderkey) m
    ON i.l_orderkey = m.l_orderkey
  LEFT JOIN supp sp ON i.l_suppkey = sp.s_suppkey
  JOIN oe ON i.l_orderkey = oe.Rww_ID
)"""


def with_ctes(*fragments: str) -> str:
    return "WITH " + ",".join(f.strip("\n") for f in fragments)


def round6(text: str) -> str:
    """Rewrite every ``round(x, 6)`` as floor(x * 1e6 + 0.5) / 1e6 (the rule the
    Spark side uses), so both engines take identical IEEE steps."""
    out, i = [], 0
    while True:
        j = text.find("round(", i)
        if j < 0 or (j > 0 and (text[j - 1].isalnum() or text[j - 1] == "_")):
            if j < 0:
                out.append(text[i:])
                return "".join(out)
            out.append(text[i:j + 6])
            i = j + 6
            continue
        depth, k = 1, j + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(text[k], 0)
            k += 1
        inner = text[j + 6:k - 1]
        if inner.rstrip().endswith(", 6"):
            arg = round6(inner.rstrip()[:-3])
            out.append(text[i:j] + f"(floor(({arg}) * 1000000.0 + 0.5) / 1000000.0)")
        elif inner.rstrip().endswith(", 9"):
            arg = round6(inner.rstrip()[:-3])
            out.append(text[i:j] + f"(floor(({arg}) * 1000000000.0 + 0.5) / 1000000000.0)")
        else:
            out.append(text[i:j] + "round(" + round6(inner) + ")")
        i = k


def sql(select: str, *extra: str, items: bool = False) -> str:
    """Full statement: fixture CTEs (+ item table) + extra CTEs + final SELECT."""
    frags = [_ITEMS] + ([_ORDER_ITEMS] if items else []) + list(extra)
    return round6(with_ctes(*frags) + "\n" + select.strip() + "\n")


ORDERS_ENRICHED = sql("SELECT * FROM oe")
ORDER_ITEMS = sql("SELECT * FROM oi", items=True)


# --- expression helpers (SQL text) ---------------------------------------

PTS, APPR = "order_purchase_timestamp", "order_approved_at"
CARR, DELIV = "order_delivered_carrier_date", "order_delivered_customer_date"
EST, SLF = "order_estimated_delivery_date", "ship_limit_final"


def days(a: str, b: str) -> str:
    return f"(date_diff('second', {a}, {b}) / 86400.0)"


def hours(a: str, b: str) -> str:
    return f"(date_diff('second', {a}, {b}) / 3600.0)"


def flag(cond: str) -> str:
    return f"CAST(coalesce({cond}, false) AS INTEGER)"


def rate(num: str, den: str) -> str:
    return f"round(CAST({num} AS DOUBLE) / nullif(CAST({den} AS DOUBLE), 0), 6)"


def distance(lat1: str, long1: str, lat2: str, long2: str) -> str:
    r = [f"({c} * pi() / 180.0)" for c in (lat1, long1, lat2, long2)]
    cv = f"(sin({r[0]}) * sin({r[2]}) + cos({r[0]}) * cos({r[2]}) * cos({r[1]} - {r[3]}))"
    fixed = f"(CASE WHEN abs({cv}) > 1 THEN round({cv}, 6) ELSE {cv} END)"
    return f"(CASE WHEN abs({fixed}) > 1 THEN NULL ELSE 6371.01 * acos({fixed}) END)"


def year_frac(ts: str) -> str:
    return f"(year({ts}) + CAST(month({ts}) - 1 AS DOUBLE) / 12.0)"


FEAT = f"""
feat AS (
  SELECT *,
    {days(PTS, DELIV)} AS fulfill_duration,
    {flag(f"{DELIV} >= {EST} + INTERVAL 1 DAY")} AS late_delivery_flag,
    CAST(ceil({days(PTS, EST)}) AS INTEGER) AS est_delivery_time_days,
    {days(PTS, APPR)} AS approval_time_days,
    {flag(f"{CARR} > {SLF}")} AS shipping_limit_missed,
    {days(SLF, CARR)} AS shipping_limit_miss_amt,
    {days(f"CASE WHEN {CARR} <= {SLF} THEN {CARR} ELSE {SLF} END", EST)} AS days_remaining,
    {distance('lat_seller', 'long_seller', 'lat_customer', 'long_customer')} AS distance_km,
    CAST(coalesce(customer_state, 'nan') = coalesce(seller_state, 'nan') AS INTEGER) AS states_same_or_diff,
    coalesce(customer_state, 'nan') || '-' || coalesce(seller_state, 'nan') AS state_pair,
    CAST(month({PTS}) AS INTEGER) AS purchase_mo,
    monthname({PTS}) AS purchase_mo_name,
    CAST(year({PTS}) * 100 + month({PTS}) AS INTEGER) AS purchase_yr_and_mo,
    {year_frac(PTS)} AS purchase_yr_frac,
    CAST(isodow({PTS}) - 1 AS INTEGER) AS purchase_day_of_wk,
    dayname({PTS}) AS purchase_day_name,
    CAST(month({EST}) AS INTEGER) AS est_delivery_mo,
    monthname({EST}) AS est_delivery_mo_name,
    {year_frac(EST)} AS est_delivery_yr_frac,
    dayname({EST}) AS est_delivery_day_name
  FROM oe
)"""

_OUT_OF_BOX = "(lat_customer < -34 OR lat_customer > 6 OR long_customer < -74 OR long_customer > -34)"

ITEM_FEAT = f"""
oif AS (
  SELECT *,
    {hours(PTS, DELIV)} AS delivery_hours,
    {hours(CARR, DELIV)} AS carrier_to_customer_hours,
    {hours(PTS, DELIV)} - {hours(CARR, DELIV)} AS order_to_carrier_hours,
    {flag(f"{DELIV} > {EST} + INTERVAL 1 DAY")} AS late_flag,
    CASE WHEN coalesce({_OUT_OF_BOX}, false) THEN NULL
         ELSE {distance('lat_seller', 'long_seller', 'lat_customer', 'long_customer')} END AS distance_km
  FROM oi
),
ci AS (
  SELECT * FROM oif
  WHERE {DELIV} IS NOT NULL AND {CARR} IS NOT NULL AND {CARR} <= {DELIV}
    AND {APPR} IS NOT NULL AND {APPR} <= {DELIV} AND {APPR} <= {CARR}
)"""

REG_CC_COLS = [PTS, DELIV, "distance_km", APPR, CARR, "ttl_pd"]
CLF_CC_COLS = [DELIV, "distance_km", "days_remaining", PTS, APPR, CARR, EST, SLF, "nbr_items",
               "est_delivery_time_days", "shipping_limit_missed", "shipping_limit_miss_amt"]


def _split_cte(name: str, src: str, seed: int = 42, fraction: float = 0.25) -> str:
    from .operators.sampling import key_hash_sql
    return f"""
{name}_h AS (SELECT *, {key_hash_sql('Rww_ID', seed)} AS _h FROM {src}),
{name} AS (
  SELECT * EXCLUDE (_h, _rn, _n), CAST(_rn <= ceil({fraction} * _n) AS INTEGER) AS is_test
  FROM (SELECT *, row_number() OVER (ORDER BY _h, Rww_ID) AS _rn, count(*) OVER () AS _n FROM {name}_h)
),
{name}_train AS (SELECT * EXCLUDE (is_test) FROM {name} WHERE is_test = 0),
{name}_test AS (SELECT * EXCLUDE (is_test) FROM {name} WHERE is_test = 1)"""


CC = f"""
reg_cc AS (SELECT * FROM feat WHERE {' AND '.join(c + ' IS NOT NULL' for c in REG_CC_COLS)}),
clf_cc AS (SELECT * FROM feat WHERE {' AND '.join(c + ' IS NOT NULL' for c in CLF_CC_COLS)}),""" + \
    _split_cte("reg", "reg_cc") + "," + _split_cte("clf", "clf_cc")


def on_features(select: str, *extra: str) -> str:
    return sql(select, FEAT, CC, *extra)


def on_items(select: str, *extra: str) -> str:
    return sql(select, ITEM_FEAT, *extra, items=True)


def quantiles_cte(name: str, src: str, groups: list[str], value: str, ps: list[float]) -> str:
    """CTE ``name`` with rows (groups..., p, v): exact quantiles interpolated
    the way Spark's ``percentile`` does it,
    v = (ceil(pos) - pos) * x[floor(pos)] + (pos - floor(pos)) * x[ceil(pos)], pos = (n - 1) * p,
    with x[...] the order statistics (0-based) and v = x[floor] when both are equal."""
    gsel = "".join(f"{g}, " for g in groups)
    part = f"PARTITION BY {', '.join(groups)}" if groups else ""
    qg = "".join(f"q.{g}, " for g in groups)

    def match(alias: str) -> str:
        return "".join(f"{alias}.{g} IS NOT DISTINCT FROM q.{g} AND " for g in groups)

    plist = ", ".join(f"{p!r}" for p in ps)
    return f"""
{name}_r AS (
  SELECT {gsel}CAST({value} AS DOUBLE) AS x, row_number() OVER ({part} ORDER BY {value}) - 1 AS rk,
         count(*) OVER ({part}) AS n
  FROM {src} WHERE {value} IS NOT NULL
),
{name}_q AS (
  SELECT {gsel}p, (n - 1) * p AS pos
  FROM (SELECT DISTINCT {gsel}n FROM {name}_r) t, (SELECT unnest([{plist}]::DOUBLE[]) AS p) ps
),
{name} AS (
  SELECT {qg}q.p,
         CASE WHEN floor(q.pos) = ceil(q.pos) OR lo.x = hi.x THEN lo.x
              ELSE (ceil(q.pos) - q.pos) * lo.x + (q.pos - floor(q.pos)) * hi.x END AS v
  FROM {name}_q q
  JOIN {name}_r lo ON {match('lo')}lo.rk = floor(q.pos)
  JOIN {name}_r hi ON {match('hi')}hi.rk = ceil(q.pos)
)"""


def long_values_cte(name: str, src: str, cols: list[str], keep: list[str] = ()) -> str:
    """(keep..., variabl, value DOUBLE) rows, nulls dropped (UNION ALL per column)."""
    k = "".join(f"{c}, " for c in keep)
    parts = [f"SELECT {k}'{c}' AS variabl, CAST({c} AS DOUBLE) AS value FROM {src} WHERE {c} IS NOT NULL"
             for c in cols]
    return f"\n{name} AS (\n  " + "\n  UNION ALL ".join(parts) + "\n)"


def long_levels_cte(name: str, src: str, cols: list[str], keep: list[str]) -> str:
    """(keep..., variabl, ctgry_lvl VARCHAR) rows, null levels dropped."""
    k = "".join(f"{c}, " for c in keep)
    parts = [f"SELECT {k}'{c}' AS variabl, CAST({c} AS VARCHAR) AS ctgry_lvl FROM {src} WHERE {c} IS NOT NULL"
             for c in cols]
    return f"\n{name} AS (\n  " + "\n  UNION ALL ".join(parts) + "\n)"
