"""Registered distribution / correlation queries (blueprint step 4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import oracle as O
from .catalog import _OE_TYPES, r6, r9, register, s6
from .operators import audit, distributions as D, rollups
from .plans import datasets as ds
from .plans import variables as V

DURATION_COLS = ["order_to_carrier_hours", "carrier_to_customer_hours", "delivery_hours"]


def _quant_pivot(src: str, groups: list[str], names: dict[float, str]) -> str:
    g = ", ".join(groups)
    cols = ", ".join(f"max(v) FILTER (WHERE p = {p!r}) AS {n}" for p, n in names.items())
    return f"SELECT {g}, {cols} FROM {src} GROUP BY {g}"


@register("describe_numeric", O.on_items(f"""
SELECT s.variabl, s.n, round(s.mean, 6) AS mean, round(s.std, 6) AS std, s.min,
       round(q.q25, 6) AS q25, round(q.median, 6) AS median, round(q.q75, 6) AS q75, s.max
FROM (SELECT variabl, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
             max(value) AS max FROM dlv GROUP BY variabl) s
JOIN ({_quant_pivot('dq', ['variabl'], {0.25: 'q25', 0.5: 'median', 0.75: 'q75'})}) q USING (variabl)""",
    O.long_values_cte("dlv", "ci", DURATION_COLS), O.quantiles_cte("dq", "dlv", ["variabl"], "value",
                                                                   [0.25, 0.5, 0.75])))
def q_describe(spark, sf):
    d = D.describe_numeric(ds.clean_items(spark, sf), DURATION_COLS)
    return d.select("variabl", "n", r6("mean"), r6("std"), "min", r6("q25"), r6("median"), r6("q75"), "max")


@register("box_stats", O.on_items("""
SELECT q.customer_state, q.n, round(q.q1, 6) AS q1, round(q.median, 6) AS median, round(q.q3, 6) AS q3,
       w.whisker_lo, w.whisker_hi, w.n_outliers
FROM bq_piv q JOIN (
  SELECT c.customer_state,
         min(c.delivery_hours) FILTER (WHERE c.delivery_hours >= f.lo) AS whisker_lo,
         max(c.delivery_hours) FILTER (WHERE c.delivery_hours <= f.hi) AS whisker_hi,
         count(*) FILTER (WHERE c.delivery_hours < f.lo OR c.delivery_hours > f.hi) AS n_outliers
  FROM ci c JOIN (SELECT customer_state, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM bq_piv) f
    ON c.customer_state IS NOT DISTINCT FROM f.customer_state
  WHERE c.delivery_hours IS NOT NULL GROUP BY c.customer_state
) w ON q.customer_state IS NOT DISTINCT FROM w.customer_state""",
    O.quantiles_cte("bq", "ci", ["customer_state"], "delivery_hours", [0.25, 0.5, 0.75]),
    "\nbq_piv AS (SELECT b.*, c.n FROM (" + _quant_pivot("bq", ["customer_state"],
                                                        {0.25: "q1", 0.5: "median", 0.75: "q3"}) + ") b "
    "JOIN (SELECT customer_state, count(*) AS n FROM ci WHERE delivery_hours IS NOT NULL GROUP BY 1) c "
    "ON b.customer_state IS NOT DISTINCT FROM c.customer_state)"))
def q_box_stats(spark, sf):
    b = D.box_stats(ds.clean_items(spark, sf), "delivery_hours", ["customer_state"])
    return b.select("customer_state", "n", r6("q1"), r6("median"), r6("q3"), "whisker_lo", "whisker_hi",
                    "n_outliers")


def _otr_sql():
    """The order-timing rollup CTE shared with the rollup queries."""
    from .catalog import _OTR as otr
    return otr


HOUR = 1 / 24


@register("histogram_hourly", O.on_items(f"""
SELECT CAST(bin AS BIGINT) AS bin, CASE WHEN bin >= 0 THEN 0.0 + bin * {HOUR!r} END AS bin_left, 0.0 + (bin + 1) * {HOUR!r} AS bin_right,
       count(*) AS n
FROM (SELECT CASE WHEN approval_time < 0 THEN -1 ELSE greatest(ceil((approval_time - 0.0) / {HOUR!r}) - 1, 0) END AS bin
      FROM otr WHERE approval_time IS NOT NULL)
GROUP BY bin""", _otr_sql()))
def q_histogram_hourly(spark, sf):
    """Approval time in hourly bins, right-closed with the first bin closed."""
    otr = rollups.order_timing_rollup(ds.clean_timeline_items(spark, sf))
    return D.histogram(otr, "approval_time", right=True, lo=0.0, width=HOUR)


@register("histogram", O.on_features("""
SELECT late_delivery_flag, CAST(bin AS BIGINT) AS bin, _lo + bin * _w AS bin_left, _lo + (bin + 1) * _w AS bin_right,
       count(*) AS n
FROM (
  SELECT b.late_delivery_flag, r._lo, r._w,
         CASE WHEN r._w = 0 THEN 0 ELSE least(floor((b.distance_km - r._lo) / r._w), 10 - 1) END AS bin
  FROM clf_train b JOIN (
    SELECT late_delivery_flag, CAST(min(distance_km) AS DOUBLE) AS _lo,
           CAST(max(distance_km) - min(distance_km) AS DOUBLE) / 10 AS _w
    FROM clf_train WHERE distance_km IS NOT NULL GROUP BY 1) r USING (late_delivery_flag)
  WHERE b.distance_km IS NOT NULL)
GROUP BY ALL"""))
def q_histogram(spark, sf):
    """Ten equal-width bins of distance per late flag (left-closed, last closed)."""
    train, _ = ds.clf_split(spark, sf)
    return D.histogram(train, "distance_km", bins=10, by=["late_delivery_flag"])


_QB_PS = [i / 50 for i in range(51)]


@register("odds_by_quantile_bin", O.on_features(f"""
SELECT l.variabl, CAST(l.bin AS INTEGER) AS bin, round(e.edges[l.bin], 6) AS bin_left,
       round(e.edges[l.bin + 1], 6) AS bin_right, round((e.edges[l.bin] + e.edges[l.bin + 1]) / 2, 6) AS bin_midpt,
       count(*) AS nbr, CAST(sum(l.late_delivery_flag) AS BIGINT) AS nbr_late,
       round(CAST(sum(l.late_delivery_flag) AS DOUBLE) / count(*), 6) AS pct_late
FROM (SELECT q.variabl, q.late_delivery_flag,
             greatest(1, len(list_filter(e.edges, lambda x: x < q.value))) AS bin
      FROM qb_lv q JOIN qb_edges e USING (variabl)) l
JOIN qb_edges e USING (variabl)
GROUP BY l.variabl, l.bin, e.edges""",
    O.long_values_cte("qb_lv0", "clf_train", V.CLF_CONT_EDA, keep=["late_delivery_flag"]),
    f"\nqb_lv AS (SELECT * FROM qb_lv0 WHERE NOT (variabl = 'shipping_limit_miss_amt' AND value <= {V.SHIP_MISS_TRIM}))",
    O.quantiles_cte("qb_q", "qb_lv", ["variabl"], "value", _QB_PS),
    "\nqb_edges AS (SELECT variabl, list_sort(list_distinct(list(v))) AS edges FROM qb_q GROUP BY variabl)"))
def q_odds_by_qbin(spark, sf):
    train, _ = ds.clf_split(spark, sf, [V.CLF_TARGET, *V.CLF_CONT_EDA])
    o = D.quantile_bin_odds(train, V.CLF_CONT_EDA, trims={"shipping_limit_miss_amt": V.SHIP_MISS_TRIM})
    return o.select("variabl", F.col("bin").cast("int").alias("bin"), r6("bin_left"), r6("bin_right"),
                    r6("bin_midpt"), "nbr", "nbr_late", r6("pct_late"))


def _unpivot_sql(select_wide: str, names: list[str], name_col: str, value_col: str) -> str:
    cols = ", ".join(f'"{n}"' for n in names)
    return f"FROM ({select_wide}) w UNPIVOT INCLUDE NULLS ({value_col} FOR {name_col} IN ({cols}))"


def _corr_sql(src: str, cols: list[str], where: str = "") -> str:
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    sel = ", ".join(f'corr({a}, {b}) AS "{a}|{b}"' for a, b in pairs)
    return f"""
SELECT split_part(pair, '|', 1) AS col_i, split_part(pair, '|', 2) AS col_j,
       round(CASE WHEN isnan(c) THEN NULL ELSE c END, 6) AS corr
{_unpivot_sql(f"SELECT {sel} FROM {src} {where}", [f"{a}|{b}" for a, b in pairs], "pair", "c")}"""


@register("corr_pairwise", O.on_features(_corr_sql("reg_train", V.REG_CORR_VARS)))
def q_corr_pairwise(spark, sf):
    train, _ = ds.reg_split(spark, sf, V.REG_CORR_VARS)
    return D.corr_pairs(train, V.REG_CORR_VARS).select("col_i", "col_j", r6("corr"))


@register("corr_listwise", O.on_items(_corr_sql(
    "ci", V.ITEM_NUMERIC_EXT, "WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in V.ITEM_NUMERIC_EXT))))
def q_corr_listwise(spark, sf):
    return D.corr_pairs(ds.clean_items(spark, sf), V.ITEM_NUMERIC_EXT, listwise=True).select(
        "col_i", "col_j", r6("corr"))


_RANK_FEATS = [c for c in V.REG_CORR_VARS if c != V.REG_TARGET and c not in V.LATE_KNOWN_VARS]
_RANK_SQL = ("SELECT feature, round(corr, 6) AS corr, round(abs(corr), 6) AS abs_corr "
             + _unpivot_sql("SELECT " + ", ".join(f'corr({c}, {V.REG_TARGET}) AS "{c}"' for c in _RANK_FEATS)
                            + " FROM reg_train", _RANK_FEATS, "feature", "corr"))


def _corr_rank(spark, sf):
    train, _ = ds.reg_split(spark, sf, V.REG_CORR_VARS)
    r = D.corr_with_target(train, V.REG_TARGET, V.REG_CORR_VARS, exclude=V.LATE_KNOWN_VARS)
    return r.select("feature", r6("corr"), r6("abs_corr"))


@register("feature_corr_rank", O.on_features(_RANK_SQL))
def q_feature_corr_rank(spark, sf):
    return _corr_rank(spark, sf)


TOP_K = 10


@register("top_k_features", O.on_features(f"SELECT * FROM ({_RANK_SQL}) ORDER BY abs_corr DESC LIMIT {TOP_K}"))
def q_top_k(spark, sf):
    """Top-k predictors by |corr| with the target (the limit is the feature)."""
    return _corr_rank(spark, sf).orderBy(F.desc("abs_corr")).limit(TOP_K)


@register("scatter_bins", O.on_features("""
SELECT CAST(floor(distance_km / 100.0) AS BIGINT) AS x_bin, CAST(floor(fulfill_duration / 1.0) AS BIGINT) AS y_bin,
       count(*) AS n
FROM reg_train WHERE distance_km IS NOT NULL AND fulfill_duration IS NOT NULL GROUP BY 1, 2"""))
def q_scatter_bins(spark, sf):
    train, _ = ds.reg_split(spark, sf)
    return D.bins_2d(train, "distance_km", "fulfill_duration", 100.0, 1.0)


@register("value_counts", O.on_features(
    "SELECT product_ctgry_mfu, count(*) AS n FROM feat WHERE product_ctgry_mfu IS NOT NULL GROUP BY 1"))
def q_value_counts(spark, sf):
    return rollups.value_counts(ds.order_features(spark, sf), "product_ctgry_mfu")


_TAIL_COLS = ["Rww_ID", O.PTS, O.APPR, O.CARR, O.EST, O.SLF, O.DELIV, "est_delivery_time_days", "seller_state",
              "customer_state"]


@register("tail_rows", O.on_features(
    f"SELECT {', '.join(_TAIL_COLS)}, {s6('distance_km')} FROM clf_train WHERE distance_km > {V.DISTANCE_MAX_KM}"))
def q_tail_rows(spark, sf):
    train, _ = ds.clf_split(spark, sf)
    t = audit.tail_rows(train, "distance_km", V.DISTANCE_MAX_KM, _TAIL_COLS + ["distance_km"])
    return t.select(*_TAIL_COLS, r6("distance_km"))


@register("describe_order_timing", O.on_items(f"""
SELECT s.variabl, s.n, round(s.mean, 6) AS mean, round(s.std, 6) AS std, round(s.min, 6) AS min,
       round(q.q25, 6) AS q25, round(q.median, 6) AS median, round(q.q75, 6) AS q75, round(s.max, 6) AS max
FROM (SELECT variabl, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
             max(value) AS max FROM tlv GROUP BY variabl) s
JOIN ({_quant_pivot('tq', ['variabl'], {0.25: 'q25', 0.5: 'median', 0.75: 'q75'})}) q USING (variabl)""",
    _otr_sql(), O.long_values_cte("tlv", "otr", ["nbr_items", "approval_time", "est_time"]),
    O.quantiles_cte("tq", "tlv", ["variabl"], "value", [0.25, 0.5, 0.75])))
def q_describe_timing(spark, sf):
    """A15: summary of the order-timing rollup and the promised days."""
    otr = rollups.order_timing_rollup(ds.clean_timeline_items(spark, sf))
    d = D.describe_numeric(otr, ["nbr_items", "approval_time", "est_time"])
    return d.select("variabl", "n", *[r6(c) for c in ("mean", "std", "min", "q25", "median", "q75", "max")])


@register("histogram_by_flag", O.on_features("""
SELECT variabl, late_delivery_flag, CAST(bin AS BIGINT) AS bin, round(_lo + bin * _w, 6) AS bin_left,
       round(_lo + (bin + 1) * _w, 6) AS bin_right, count(*) AS n
FROM (
  SELECT b.variabl, b.late_delivery_flag, r._lo, r._w,
         CASE WHEN r._w = 0 THEN 0 ELSE least(floor((b.value - r._lo) / r._w), 10 - 1) END AS bin
  FROM hl b JOIN (SELECT variabl, late_delivery_flag, min(value) AS _lo, (max(value) - min(value)) / 10 AS _w
                  FROM hl GROUP BY 1, 2) r USING (variabl, late_delivery_flag))
GROUP BY ALL""", O.long_values_cte("hl", "clf_train", V.CLF_CONT_EDA, keep=["late_delivery_flag"])))
def q_histogram_by_flag(spark, sf):
    """A17: ten equal-width bins of every continuous variable per late flag."""
    train, _ = ds.clf_split(spark, sf, [V.CLF_TARGET, *V.CLF_CONT_EDA])
    lv = D.long_values(train, V.CLF_CONT_EDA, keep=["late_delivery_flag"])
    h = D.histogram(lv, "value", bins=10, by=["variabl", "late_delivery_flag"])
    return h.select("variabl", "late_delivery_flag", "bin", r6("bin_left"), r6("bin_right"), "n")


@register("box_stats_by_flag", O.on_features("""
SELECT q.variabl, q.late_delivery_flag, q.n, round(q.q1, 6) AS q1, round(q.median, 6) AS median, round(q.q3, 6) AS q3,
       round(w.whisker_lo, 6) AS whisker_lo, round(w.whisker_hi, 6) AS whisker_hi, w.n_outliers
FROM fb_piv q JOIN (
  SELECT l.variabl, l.late_delivery_flag, min(l.value) FILTER (WHERE l.value >= f.lo) AS whisker_lo,
         max(l.value) FILTER (WHERE l.value <= f.hi) AS whisker_hi,
         count(*) FILTER (WHERE l.value < f.lo OR l.value > f.hi) AS n_outliers
  FROM fb l JOIN (SELECT variabl, late_delivery_flag, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM fb_piv) f
    USING (variabl, late_delivery_flag)
  GROUP BY 1, 2) w USING (variabl, late_delivery_flag)""",
    O.long_values_cte("fb", "clf_train", V.CLF_CONT_EDA, keep=["late_delivery_flag"]),
    O.quantiles_cte("fb_q", "fb", ["variabl", "late_delivery_flag"], "value", [0.25, 0.5, 0.75]), """
fb_piv AS (
  SELECT variabl, late_delivery_flag, any_value(n) AS n, max(v) FILTER (WHERE p = 0.25) AS q1,
         max(v) FILTER (WHERE p = 0.5) AS median, max(v) FILTER (WHERE p = 0.75) AS q3
  FROM fb_q JOIN (SELECT variabl, late_delivery_flag, count(*) AS n FROM fb GROUP BY 1, 2) c
    USING (variabl, late_delivery_flag) GROUP BY 1, 2)"""))
def q_box_stats_by_flag(spark, sf):
    """A16: box statistics of every continuous variable by late flag."""
    train, _ = ds.clf_split(spark, sf, [V.CLF_TARGET, *V.CLF_CONT_EDA])
    lv = D.long_values(train, V.CLF_CONT_EDA, keep=["late_delivery_flag"])
    b = D.box_stats(lv, "value", ["variabl", "late_delivery_flag"])
    return b.select("variabl", "late_delivery_flag", "n", *[r6(c) for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi")],
                    "n_outliers")


# --- item-level rankings and further views -------------------------------------

_ITEM_FEATS = [c for c in V.ITEM_NUMERIC if c != "delivery_hours"]
_ITEM_RANK_SQL = ("SELECT feature, round(corr, 6) AS corr, round(abs(corr), 6) AS abs_corr "
                  + _unpivot_sql("SELECT " + ", ".join(f'corr({c}, delivery_hours) AS "{c}"' for c in _ITEM_FEATS)
                                 + " FROM ci", _ITEM_FEATS, "feature", "corr"))


@register("item_corr_rank", O.on_items(_ITEM_RANK_SQL))
def q_item_corr_rank(spark, sf):
    """M2: the item-level variables ranked by their correlation with the delivery time."""
    r = D.corr_with_target(ds.clean_items(spark, sf), "delivery_hours", V.ITEM_NUMERIC)
    return r.select("feature", r6("corr"), r6("abs_corr"))


_LEG_FEATS = [c for c in V.ITEM_NUMERIC_EXT if c != "carrier_to_customer_hours"]
_LEG_RANK_SQL = ("SELECT feature, round(corr, 6) AS corr, round(abs(corr), 6) AS abs_corr "
                 + _unpivot_sql("SELECT " + ", ".join(f'corr({c}, carrier_to_customer_hours) AS "{c}"' for c in _LEG_FEATS)
                                + " FROM ci WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in V.ITEM_NUMERIC_EXT),
                                _LEG_FEATS, "feature", "corr"))


@register("item_corr_rank_leg", O.on_items(_LEG_RANK_SQL))
def q_item_corr_rank_leg(spark, sf):
    """M2: the extended item-level list ranked by its correlation with the carrier-to-customer
    time, over the rows without a missing value."""
    r = D.corr_with_target(ds.clean_items(spark, sf), "carrier_to_customer_hours", V.ITEM_NUMERIC_EXT, listwise=True)
    return r.select("feature", r6("corr"), r6("abs_corr"))


_DURATIONS = ["order_to_carrier_hours", "carrier_to_customer_hours", "delivery_hours"]


@register("histogram_durations", O.on_items("""
SELECT variabl, CAST(bin AS BIGINT) AS bin, round(_lo + bin * _w, 6) AS bin_left, round(_lo + (bin + 1) * _w, 6) AS bin_right, count(*) AS n
FROM (SELECT b.variabl, r._lo, r._w, CASE WHEN r._w = 0 THEN 0 ELSE least(greatest(ceil((b.value - r._lo) / r._w) - 1, 0), 20 - 1) END AS bin
      FROM hd b JOIN (SELECT variabl, min(value) AS _lo, (max(value) - min(value)) / 20 AS _w FROM hd GROUP BY 1) r USING (variabl))
GROUP BY ALL""", O.long_values_cte("hd", "ci", _DURATIONS)))
def q_histogram_durations(spark, sf):
    """A17: the three durations of an order's way in twenty equal bins each, right-closed
    with the first bin closed."""
    lv = D.long_values(ds.clean_timeline_items(spark, sf), _DURATIONS)
    h = D.histogram(lv, "value", bins=20, right=True, by=["variabl"])
    return h.select("variabl", "bin", r6("bin_left"), r6("bin_right"), "n")


@register("histogram_log", O.on_features("""
SELECT CAST(bin AS BIGINT) AS bin, round(_lo + bin * _w, 6) AS bin_left, round(_lo + (bin + 1) * _w, 6) AS bin_right, count(*) AS n
FROM (SELECT r._lo, r._w, CASE WHEN r._w = 0 THEN 0 ELSE least(floor((b.x - r._lo) / r._w), 10 - 1) END AS bin
      FROM hlog b, (SELECT min(x) AS _lo, (max(x) - min(x)) / 10 AS _w FROM hlog) r)
GROUP BY ALL""", "\nhlog AS (SELECT round(ln(est_delivery_time_days), 9) AS x FROM clf_train WHERE est_delivery_time_days > 0)"))
def q_histogram_log(spark, sf):
    """A17: the logarithm of the promised days in ten equal bins (left-closed, last closed)."""
    train, _ = ds.clf_split(spark, sf)
    logs = train.where("est_delivery_time_days > 0").select(r9(F.ln("est_delivery_time_days"), "x"))
    return D.histogram(logs, "x", bins=10).select("bin", r6("bin_left"), r6("bin_right"), "n")


TOP_ORDER = 25  # as many as the analysis lists


@register("top_order_features", O.on_features(f"SELECT * FROM ({_RANK_SQL}) ORDER BY abs_corr DESC LIMIT {TOP_ORDER}"))
def q_top_order(spark, sf):
    """O2: the 25 strongest order-level correlations (the limit is the feature)."""
    return _corr_rank(spark, sf).orderBy(F.desc("abs_corr")).limit(TOP_ORDER)


@register("numeric_columns", O.sql(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS data_type, count({c}) AS non_null FROM oe"
    for c, t in _OE_TYPES.items() if t in ("int", "bigint", "double") and c != "Rww_ID")))
def q_numeric_columns(spark, sf):
    """P2: the numeric columns of the order table, found by type, with their non-null counts."""
    orders = ds.orders(spark, sf)
    return audit.profile_columns(orders.select(*audit.numeric_columns(orders, exclude=["Rww_ID"])))
