"""Registered level-statistics queries (blueprint step 5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import oracle as O
from .catalog import r6, r9, register
from .operators import levels as L
from .operators import levelstate as S
from .plans import datasets as ds
from .plans import variables as V
from .session import stored_table

LVL_PS = [0.25, 0.75]


# Level-count limits of these queries, the same at every scale factor: the small
# tables have few levels with the defaults' 37, 75 and 50 rows.
MIN_LOW, MIN_HIGH, MIN_MOVER = 6, 11, 8


# --- SQL fragments ------------------------------------------------------------

_LS = (O.long_levels_cte("ls_lv0", "reg_train", V.REG_HICARD, [V.REG_TARGET])
       + ",\nls_lv AS (SELECT * FROM ls_lv0 WHERE fulfill_duration IS NOT NULL),"
       + O.quantiles_cte("ls_q", "ls_lv", ["variabl", "ctgry_lvl"], V.REG_TARGET, LVL_PS) + """,
ls AS (
  SELECT s.*, q.lvl_1qtle, q.lvl_3qtle FROM (
    SELECT variabl, ctgry_lvl, count(*) AS nbr, avg(fulfill_duration) AS lvl_mean,
           stddev_samp(fulfill_duration) AS lvl_std, min(fulfill_duration) AS lvl_min,
           max(fulfill_duration) AS lvl_max
    FROM ls_lv GROUP BY variabl, ctgry_lvl) s
  JOIN (SELECT variabl, ctgry_lvl, max(v) FILTER (WHERE p = 0.25) AS lvl_1qtle,
               max(v) FILTER (WHERE p = 0.75) AS lvl_3qtle FROM ls_q GROUP BY variabl, ctgry_lvl) q
    USING (variabl, ctgry_lvl)
),
bm AS (
  SELECT ls.* FROM ls, (SELECT avg(fulfill_duration) AS m FROM reg_train) o
  WHERE ls.nbr > """ + str(MIN_MOVER) + """ AND (ls.lvl_1qtle > o.m OR ls.lvl_3qtle < o.m)
)""")

_LO = (O.long_levels_cte("lo_lv", "clf_train", V.CLF_CATEGORICAL, [V.CLF_TARGET]) + """,
lo AS (
  SELECT variabl, ctgry_lvl, count(*) AS nbr, CAST(sum(late_delivery_flag) AS BIGINT) AS nbr_late,
         CAST(sum(late_delivery_flag) AS DOUBLE) / count(*) AS odds
  FROM lo_lv GROUP BY variabl, ctgry_lvl
),
lo_all AS (SELECT avg(CAST(late_delivery_flag AS DOUBLE)) AS rate, count(*) AS n FROM clf_train),
imp AS (
  SELECT lo.variabl, lo.ctgry_lvl, lo.nbr, lo.nbr_late, lo.odds,
         CASE WHEN lo.variabl IN (""" + ", ".join(f"'{v}'" for v in V.CLF_LOWCARD) + """) THEN 'low' ELSE 'high' END
           AS cardinality,
         CAST(lo.odds > a.rate * """ + repr(L.MAJOR_HIGH) + " OR lo.odds < a.rate * " + repr(L.MAJOR_LOW) + """ AS INTEGER)
           AS major_impact_flag
  FROM lo, lo_all a
  WHERE (lo.odds > a.rate * """ + repr(L.IMPACT_HIGH) + " OR lo.odds < a.rate * " + repr(L.IMPACT_LOW) + """)
    AND ((lo.variabl IN (""" + ", ".join(f"'{v}'" for v in V.CLF_LOWCARD) + ") AND lo.nbr >= "
       + str(MIN_LOW) + """)
      OR (lo.variabl IN (""" + ", ".join(f"'{v}'" for v in V.CLF_HICARD) + ") AND lo.nbr >= "
       + str(MIN_HIGH) + """))
),
maj AS (SELECT * FROM imp WHERE major_impact_flag = 1)""")


# --- Spark helpers --------------------------------------------------------------

def _level_stats(spark, sf):
    train, _ = ds.reg_split(spark, sf, [V.REG_TARGET, *V.REG_HICARD])
    return train, L.level_stats(train, V.REG_HICARD, V.REG_TARGET)


def _movers(spark, sf):
    train, stats = _level_stats(spark, sf)
    return L.big_movers(stats, train, V.REG_TARGET, MIN_MOVER)


def _odds(spark, sf, keep=()):
    """Training rows (with the columns ``keep`` too) and their level odds."""
    train, _ = ds.clf_split(spark, sf, [V.CLF_TARGET, *V.CLF_CATEGORICAL, *keep])
    return train, L.level_odds(train, V.CLF_CATEGORICAL, V.CLF_TARGET)


def _impactful(spark, sf):
    train, odds = _odds(spark, sf)
    return odds, L.impactful_levels(odds, train, V.CLF_TARGET, V.CLF_LOWCARD, V.CLF_HICARD, MIN_LOW, MIN_HIGH)


_STAT_OUT = ["lvl_mean", "lvl_std", "lvl_min", "lvl_max", "lvl_1qtle", "lvl_3qtle"]
_STAT_SQL = ", ".join(f"round({c}, 9) AS {c}" for c in _STAT_OUT)


@register("level_stats", O.on_features(f"SELECT variabl, ctgry_lvl, nbr, {_STAT_SQL} FROM ls", _LS))
def q_level_stats(spark, sf):
    _, stats = _level_stats(spark, sf)
    return stats.select("variabl", "ctgry_lvl", "nbr", *[r9(c) for c in _STAT_OUT])


@register("big_movers", O.on_features(f"SELECT variabl, ctgry_lvl, nbr, {_STAT_SQL} FROM bm", _LS))
def q_big_movers(spark, sf):
    return _movers(spark, sf).select("variabl", "ctgry_lvl", "nbr", *[r9(c) for c in _STAT_OUT])


@register("distinct_levels", O.on_features("SELECT DISTINCT variabl FROM bm", _LS))
def q_distinct_levels(spark, sf):
    """Variables that have at least one significant level (set semantics)."""
    return _movers(spark, sf).select("variabl").distinct()


@register("level_odds", O.on_features(
    "SELECT variabl, ctgry_lvl, nbr, nbr_late, round(odds, 6) AS odds FROM lo", _LO))
def q_level_odds(spark, sf):
    _, odds = _odds(spark, sf)
    return odds.select("variabl", "ctgry_lvl", "nbr", "nbr_late", r6("odds"))


@register("impactful_levels", O.on_features(
    "SELECT variabl, ctgry_lvl, nbr, nbr_late, round(odds, 6) AS odds, cardinality, major_impact_flag FROM imp",
    _LO))
def q_impactful(spark, sf):
    _, imp = _impactful(spark, sf)
    return imp.select("variabl", "ctgry_lvl", "nbr", "nbr_late", r6("odds"), "cardinality", "major_impact_flag")


@register("level_cardinality", O.on_features(
    "SELECT variabl, count(DISTINCT ctgry_lvl) AS nbr_lvls FROM lo GROUP BY variabl", _LO))
def q_level_cardinality(spark, sf):
    _, odds = _odds(spark, sf)
    return L.level_cardinality(odds)


LATER = 1996  # purchase year from which orders count as the later batch
_DAY_UNITS = 86400.0  # durations in days are whole seconds


def _batches(df):
    later = F.year("order_purchase_timestamp") >= LATER
    return df.where(~later), df.where(later)


@register("level_state", O.on_features("""
SELECT variabl, ctgry_lvl, nbr, round(lvl_mean, 6) AS lvl_mean, round(lvl_std, 6) AS lvl_std, lvl_min, lvl_max,
       true AS lvl_1qtle_ok, true AS lvl_3qtle_ok FROM ls""", _LS))
def q_level_state(spark, sf):
    """Level statistics of the duration from the stored state of the earlier orders and
    that of a later batch, merged; and whether the merged sketch's quartiles keep the
    promised rank among all values of their level."""
    train, _ = ds.reg_split(spark, sf, ["order_purchase_timestamp", V.REG_TARGET, *V.REG_HICARD])
    train = stored_table(train.select("order_purchase_timestamp", V.REG_TARGET, *V.REG_HICARD), "level-rows")
    stored = None
    for i, batch in enumerate(_batches(train)):
        new = S.level_state(batch, V.REG_HICARD, V.REG_TARGET, _DAY_UNITS)
        stored = stored_table(new if stored is None else S.merge_states(stored, new), f"level-state-{i}")
    stats = S.state_stats(stored, _DAY_UNITS, LVL_PS)
    rows = L.long_levels(train.where(F.col(V.REG_TARGET).isNotNull()), V.REG_HICARD, [V.REG_TARGET])
    x = F.col(V.REG_TARGET)
    ranks = rows.join(stats.select("variabl", "ctgry_lvl", "q"), ["variabl", "ctgry_lvl"]).groupBy("variabl", "ctgry_lvl").agg(
        *[F.count_if(x < F.col("q")[i]).alias(f"below{i}") for i in range(2)],
        *[F.count_if(x <= F.col("q")[i]).alias(f"upto{i}") for i in range(2)])
    ok = [(S.rank_gap(F.col(f"below{i}"), F.col(f"upto{i}"), F.col("nbr"), p) <= S.RANK_ERROR).alias(name)
          for i, (p, name) in enumerate(zip(LVL_PS, ("lvl_1qtle_ok", "lvl_3qtle_ok")))]
    return stats.join(ranks, ["variabl", "ctgry_lvl"]).select(
        "variabl", "ctgry_lvl", "nbr", r6("lvl_mean"), r6("lvl_std"), "lvl_min", "lvl_max", *ok)


@register("level_cardinality_sketch", O.on_features(
    "SELECT variabl, count(DISTINCT ctgry_lvl) AS nbr_lvls, true AS within_bound FROM lo GROUP BY variabl", _LO))
def q_level_cardinality_sketch(spark, sf):
    """A10: distinct levels per variable beside the estimate of sketches merged from two
    batches: whether the exact count is within the estimate's bounds."""
    train, odds = _odds(spark, sf, ["order_purchase_timestamp"])
    estimate = S.distinct_estimate(S.merge_distinct(*[S.distinct_state(b, V.CLF_CATEGORICAL) for b in _batches(train)]))
    n = F.col("nbr_lvls")
    return L.level_cardinality(odds).join(estimate, "variabl").select(
        "variabl", "nbr_lvls", ((n >= F.col("low_est")) & (n <= F.col("high_est"))).alias("within_bound"))


@register("late_rate_by_month", O.on_features("""
SELECT CAST(ctgry_lvl AS INTEGER) AS purchase_yr_and_mo, round(odds, 6) AS odds,
       round(round(CAST(ctgry_lvl AS INTEGER) / 100, 0) + (CAST(ctgry_lvl AS INTEGER) % 100) / 12, 6) AS prch_yr_and_mo
FROM lo WHERE variabl = 'purchase_yr_and_mo'""", _LO))
def q_late_rate_by_month(spark, sf):
    """Late rate per purchase month with the plotting x = round(yyyymm/100) + mm/12."""
    _, odds = _odds(spark, sf)
    ym = F.col("ctgry_lvl").cast("int")
    return (odds.where(F.col("variabl") == "purchase_yr_and_mo")
            .select(ym.alias("purchase_yr_and_mo"), r6("odds"),
                    r6(F.round(ym / 100, 0) + (ym % 100) / 12, "prch_yr_and_mo"))
            .orderBy("prch_yr_and_mo"))


@register("odds_with_others", O.on_features(f"""
SELECT lo.variabl, CASE WHEN k.ctgry_lvl IS NOT NULL THEN lo.ctgry_lvl ELSE '{L.ALL_OTHERS_ODDS}' END AS ctgry_lvl_str,
       CAST(sum(lo.nbr) AS BIGINT) AS nbr, CAST(sum(lo.nbr_late) AS BIGINT) AS nbr_late,
       round(CAST(sum(lo.nbr_late) AS DOUBLE) / sum(lo.nbr), 6) AS odds
FROM lo LEFT JOIN (SELECT DISTINCT variabl, ctgry_lvl FROM maj) k USING (variabl, ctgry_lvl)
WHERE lo.variabl IN (SELECT variabl FROM maj)
GROUP BY 1, 2""", _LO))
def q_odds_with_others(spark, sf):
    odds, imp = _impactful(spark, sf)
    out = L.odds_with_others(odds, imp.where(F.col("major_impact_flag") == 1))
    return out.select("variabl", "ctgry_lvl_str", "nbr", "nbr_late", r6("odds"))


_LOWCARD_IN = ", ".join(f"'{v}'" for v in V.CLF_LOWCARD)


@register("lowcard_odds", O.on_features(
    f"SELECT variabl, ctgry_lvl, nbr, nbr_late, round(odds, 6) AS odds FROM lo WHERE variabl IN ({_LOWCARD_IN})", _LO))
def q_lowcard_odds(spark, sf):
    """A9: late rates of the low-cardinality variables, in level order."""
    _, odds = _odds(spark, sf)
    return (odds.where(F.col("variabl").isin(V.CLF_LOWCARD)).orderBy("variabl", "ctgry_lvl")
            .select("variabl", "ctgry_lvl", "nbr", "nbr_late", r6("odds")))


MIN_ZIP_ROWS = 10


@register("zip_odds", O.on_features(
    f"SELECT ctgry_lvl AS customer_zip_code_prefix, nbr, nbr_late, round(odds, 6) AS odds FROM lo "
    f"WHERE variabl = 'customer_zip_code_prefix' AND nbr >= {MIN_ZIP_ROWS}", _LO))
def q_zip_odds(spark, sf):
    """A9: late rates of the customer zip prefixes with ten orders or more."""
    _, odds = _odds(spark, sf)
    return (odds.where((F.col("variabl") == "customer_zip_code_prefix") & (F.col("nbr") >= MIN_ZIP_ROWS))
            .select(F.col("ctgry_lvl").alias("customer_zip_code_prefix"), "nbr", "nbr_late", r6("odds")))


# --- rare-level grouping and one-hot encodings ---------------------------------

def _grouped_sql_cols() -> str:
    return ", ".join(
        f"CASE WHEN CAST({c} AS VARCHAR) IN (SELECT ctgry_lvl FROM bm WHERE variabl = '{c}') "
        f"THEN CAST({c} AS VARCHAR) ELSE '{L.ALL_OTHERS_GROUPED}' END AS {c}__grpd" for c in V.REG_HICARD)


_GRP = _LS + f""",
grp AS (
  SELECT Rww_ID, 'train' AS part, {_grouped_sql_cols()} FROM reg_train
  UNION ALL SELECT Rww_ID, 'test' AS part, {_grouped_sql_cols()} FROM reg_test
)"""
_GRPD = [c + "__grpd" for c in V.REG_HICARD]


def _grouped(spark, sf):
    train, test = ds.reg_split(spark, sf, [V.REG_TARGET, *V.REG_HICARD])
    stats = L.level_stats(train, V.REG_HICARD, V.REG_TARGET)
    movers = L.big_movers(stats, train, V.REG_TARGET, MIN_MOVER)
    both = (train.select("Rww_ID", F.lit("train").alias("part"), *V.REG_HICARD)
            .unionByName(test.select("Rww_ID", F.lit("test").alias("part"), *V.REG_HICARD)))
    return L.group_rare_levels(both, movers, V.REG_HICARD).select("Rww_ID", "part", *_GRPD)


@register("group_rare_levels", O.on_features("SELECT * FROM grp", _GRP))
def q_group_rare_levels(spark, sf):
    return _grouped(spark, sf)


@register("one_hot_grouped", O.on_features(f"""
SELECT g.Rww_ID, g.part, substr(g.variabl, 1, length(g.variabl) - 6) || '__' || replace(g.ctgry_lvl, ' ', '_') AS dummy
FROM gl g JOIN (SELECT DISTINCT variabl, ctgry_lvl FROM gl WHERE part = 'train') t USING (variabl, ctgry_lvl)""",
    _GRP + "," + O.long_levels_cte("gl", "grp", _GRPD, ["Rww_ID", "part"])))
def q_one_hot_grouped(spark, sf):
    """Regression-style one-hot of the grouped columns: every training level
    becomes an indicator; the test set uses the training levels (sparse long
    form: one row per indicator equal to 1)."""
    g = _grouped(spark, sf)
    train_levels = L.long_levels(g.where(F.col("part") == "train"), _GRPD, []).distinct()
    keyed = g.withColumn("_k", F.struct("Rww_ID", "part"))
    out = L.one_hot_long(keyed, "_k", _GRPD, train_levels, "__", strip_suffix="__grpd")
    return out.select("_k.Rww_ID", "_k.part", "dummy")


@register("one_hot_major", O.on_features("""
SELECT l.Rww_ID, l.part, l.variabl || '_' || replace(l.ctgry_lvl, ' ', '_') AS dummy
FROM ml l JOIN (SELECT DISTINCT variabl, ctgry_lvl FROM maj) m USING (variabl, ctgry_lvl)""",
    _LO + ",\nsplit_both AS (SELECT *, 'train' AS part FROM clf_train UNION ALL SELECT *, 'test' AS part FROM clf_test),"
    + O.long_levels_cte("ml", "split_both", V.CLF_LOWCARD + V.CLF_HICARD, ["Rww_ID", "part"])))
def q_one_hot_major(spark, sf):
    """Classifier-style one-hot: indicators only for the major-impact levels
    (levels compared as strings, so numeric-looking zip prefixes match)."""
    train, test = ds.clf_split(spark, sf, [V.CLF_TARGET, *V.CLF_CATEGORICAL])
    odds = L.level_odds(train, V.CLF_CATEGORICAL, V.CLF_TARGET)
    major = L.impactful_levels(odds, train, V.CLF_TARGET, V.CLF_LOWCARD, V.CLF_HICARD, MIN_LOW, MIN_HIGH).where(
        F.col("major_impact_flag") == 1)
    cols = V.CLF_LOWCARD + V.CLF_HICARD
    both = (train.select("Rww_ID", F.lit("train").alias("part"), *cols)
            .unionByName(test.select("Rww_ID", F.lit("test").alias("part"), *cols)))
    keyed = both.withColumn("_k", F.struct("Rww_ID", "part"))
    return L.one_hot_long(keyed, "_k", cols, major, "_").select("_k.Rww_ID", "_k.part", "dummy")
