"""Statistics by categorical level, significant-level selection, rare-level
grouping and one-hot encoding.

All variables are handled in one job over a long (variabl, ctgry_lvl) form:
``unpivot`` of the level columns cast to string, then one ``groupBy``.  That
replaces a scan per (variable, level) by one shuffle of partially aggregated
rows; a level holding a third of all rows is reduced map-side before it is
shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored_table
from ..sources.tables import sized_broadcast
from .distributions import group_quantiles

ALL_OTHERS_GROUPED = " ALL OTHERS"   # bucket name of rare-level grouping (fixed value)
ALL_OTHERS_ODDS = "_All others"      # bucket name of the key-level odds view (fixed value)

# Fixed values of the significant-level rules: thresholds relative to the
# overall rate, and minimum level counts (37 for low-cardinality, 75 for
# high-cardinality variables; more than 50 rows for duration statistics).  They
# are absolute counts: they do not change with the size of the table.
IMPACT_LOW, IMPACT_HIGH = 0.75, 1.25
MAJOR_LOW, MAJOR_HIGH = 0.5, 1.5
MIN_N_LOWCARD, MIN_N_HICARD, MIN_N_MOVER = 37, 75, 50


def long_levels(df: DataFrame, cols: list[str], keep: list[str]) -> DataFrame:
    """(keep..., variabl, ctgry_lvl) with levels cast to string; null levels dropped."""
    casted = df.select(*keep, *[F.col(c).cast("string").alias(c) for c in cols])
    return (casted.unpivot(list(keep), cols, "variabl", "ctgry_lvl")
            .where(F.col("ctgry_lvl").isNotNull()))


def level_stats(df: DataFrame, cols: list[str], target: str, exact: bool = True) -> DataFrame:
    """Per (variabl, ctgry_lvl): nbr, mean, sample std, min, max, q25, q75 of ``target``."""
    lv = long_levels(df.where(F.col(target).isNotNull()), cols, [target])
    keys = ["variabl", "ctgry_lvl"]
    q = group_quantiles(lv, keys, target, [0.25, 0.75], exact)
    stats = lv.groupBy(*keys).agg(F.avg(target).alias("lvl_mean"), F.stddev_samp(target).alias("lvl_std"),
                                  F.min(target).alias("lvl_min"), F.max(target).alias("lvl_max"))
    return (stats.join(q, keys)
            .select(*keys, F.col("n").alias("nbr"), "lvl_mean", "lvl_std", "lvl_min", "lvl_max",
                    F.col("q")[0].alias("lvl_1qtle"), F.col("q")[1].alias("lvl_3qtle")))


def big_movers(stats: DataFrame, train: DataFrame, target: str, min_n: int = MIN_N_MOVER) -> DataFrame:
    """Levels with more than ``min_n`` rows whose interquartile box lies wholly
    above or below the overall mean of the target."""
    overall = train.agg(F.avg(target).alias("_mean"))
    return (stats.crossJoin(F.broadcast(overall))  # one row
            .where((F.col("nbr") > min_n)
                   & ((F.col("lvl_1qtle") > F.col("_mean")) | (F.col("lvl_3qtle") < F.col("_mean"))))
            .drop("_mean"))


def level_odds(df: DataFrame, cols: list[str], flag: str) -> DataFrame:
    """Per (variabl, ctgry_lvl): nbr, nbr_late, odds (= share late)."""
    lv = long_levels(df, cols, [flag])
    return (lv.groupBy("variabl", "ctgry_lvl")
            .agg(F.count(F.lit(1)).alias("nbr"), F.sum(flag).cast("bigint").alias("nbr_late"))
            .withColumn("odds", F.try_divide(F.col("nbr_late").cast("double"), F.col("nbr").cast("double"))))


def impactful_levels(odds: DataFrame, train: DataFrame, flag: str, lowcard: list[str], hicard: list[str],
                     min_low: int = MIN_N_LOWCARD, min_high: int = MIN_N_HICARD) -> DataFrame:
    """Levels whose late rate is far from the overall rate.

    impactful: odds > 1.25 x overall or < 0.75 x overall (strict); low-cardinality
    variables need ``min_low`` rows, high-cardinality ones ``min_high``.
    major_impact_flag: odds > 1.5 x or < 0.5 x overall.  The overall rate is
    computed from ``train``, not hard-coded.
    """
    overall = train.agg(F.avg(F.col(flag).cast("double")).alias("_rate"))
    o = odds.crossJoin(F.broadcast(overall))  # one row
    rate = F.col("_rate")
    impact = (F.col("odds") > rate * IMPACT_HIGH) | (F.col("odds") < rate * IMPACT_LOW)
    major = (F.col("odds") > rate * MAJOR_HIGH) | (F.col("odds") < rate * MAJOR_LOW)
    card = (F.when(F.col("variabl").isin(lowcard), F.lit("low"))
            .when(F.col("variabl").isin(hicard), F.lit("high")))
    size_ok = F.when(card == "low", F.col("nbr") >= min_low).otherwise(F.col("nbr") >= min_high)
    return (o.where(card.isNotNull() & impact & size_ok)
            .select("variabl", "ctgry_lvl", "nbr", "nbr_late", "odds", card.alias("cardinality"),
                    major.cast("int").alias("major_impact_flag")))


def level_cardinality(odds: DataFrame) -> DataFrame:
    """Distinct levels per variable."""
    return odds.groupBy("variabl").agg(F.count_distinct("ctgry_lvl").alias("nbr_lvls"))


def odds_with_others(odds: DataFrame, key_levels: DataFrame) -> DataFrame:
    """Key levels of each variable plus one ``_All others`` row pooling the rest.

    Only variables that have key levels are reported.  No union is needed:
    levels are relabelled by a join with the (small) key-level set and grouped.
    """
    keys = key_levels.select("variabl", "ctgry_lvl", F.lit(True).alias("_key")).distinct()
    keyed_vars = keys.select("variabl").distinct()
    keys = sized_broadcast(keys)
    # keyed_vars holds at most one row per analysed variable
    o = (odds.join(F.broadcast(keyed_vars), "variabl", "left_semi")
         .join(keys, ["variabl", "ctgry_lvl"], "left"))
    bucket = F.when(F.col("_key"), F.col("ctgry_lvl")).otherwise(F.lit(ALL_OTHERS_ODDS))
    return (o.groupBy("variabl", bucket.alias("ctgry_lvl_str"))
            .agg(F.sum("nbr").alias("nbr"), F.sum("nbr_late").alias("nbr_late"))
            .withColumn("odds", F.try_divide(F.col("nbr_late").cast("double"), F.col("nbr").cast("double"))))


MAX_SLOTS = 200_000  # levels of a dictionary altogether; a model's vector has a slot for each
CELL_LEVELS = 4  # levels of a cell, on average: a map is searched from end to end


def level_dictionary(levels: DataFrame) -> DataFrame:
    """(variabl, ctgry_lvl, slot): the listed levels of all variables, numbered from 0 in
    alphabetical order within their variable.  Written, so that its size is known;
    more than ``MAX_SLOTS`` levels are refused."""
    listed = stored_table(levels.select("variabl", "ctgry_lvl").distinct(), "levels")
    n = listed.count()
    if n > MAX_SLOTS:
        raise ValueError(f"{n} levels, more than the {MAX_SLOTS} that a dictionary holds: group rare levels first")
    place = F.row_number().over(Window.partitionBy("variabl").orderBy("ctgry_lvl")) - 1
    return stored_table(listed.withColumn("slot", place), "level-dictionary")


def _cell_key(variable, level):
    """One string for a level of a variable: no two share it."""
    return F.concat(F.length(variable).cast("string"), F.lit(":"), variable, F.lit(":"), level)


def _cell(key, n: int):
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _looked_up(df: DataFrame, dictionary: DataFrame, cols: list[str]) -> DataFrame:
    """The slots from a hash table that every task holds: an array of small maps, a level in
    the map at the place that its hash names.  It is one value (``MAX_SLOTS`` bounds it), so
    no row carries it and none is shuffled, and a lookup costs the same at any size."""
    n = max(1, dictionary.count() // CELL_LEVELS)
    key = _cell_key(F.col("variabl"), F.col("ctgry_lvl"))
    entries = dictionary.select(_cell(key, n).alias("b"), F.struct(key.alias("k"), F.col("slot").alias("v")).alias("e"))
    every = dictionary.sparkSession.range(n).select(F.col("id").cast("int").alias("b"), F.lit(None).cast(entries.schema["e"].dataType).alias("e"))
    listed = entries.unionByName(every).groupBy("b").agg(F.collect_list("e").alias("e"))  # leaves out the nulls
    cells = listed.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "e"))), lambda x: F.map_from_entries(x["e"]))).scalar()
    keys = [_cell_key(F.lit(c), F.col(c).cast("string")) for c in cols]
    return df.select(*df.columns, *[F.try_element_at(F.get(cells, _cell(k, n)), k).alias(f"{c}__slot") for c, k in zip(cols, keys)])


def with_slots(df: DataFrame, dictionary: DataFrame, cols: list[str], key: str, most: int | None = None) -> DataFrame:
    """``df`` with ``<col>__slot`` for each of ``cols``: the level's slot, null for any other.

    All columns are looked up in one step, in a hash table that every task holds.  With ``most``
    by joins instead: a dictionary of at most ``most`` levels becomes one row of maps, broadcast
    to every task.  A larger one is joined once with the long form of the columns, and the slots
    come back by the rows' unique ``key``.
    """
    if most is None:
        return _looked_up(df, dictionary, cols)
    if dictionary.count() <= most:
        each = dictionary.groupBy("variabl").agg(F.map_from_entries(F.collect_list(F.struct("ctgry_lvl", "slot"))).alias("m"))
        maps = each.agg(F.map_from_entries(F.collect_list(F.struct("variabl", "m"))).alias("_maps"))
        found = [F.try_element_at(F.try_element_at("_maps", F.lit(c)), F.col(c).cast("string")).alias(f"{c}__slot") for c in cols]
        return df.crossJoin(F.broadcast(maps)).select(*df.columns, *found)  # one row
    hits = long_levels(df, cols, [key]).join(dictionary, ["variabl", "ctgry_lvl"])
    slots = hits.groupBy(key).agg(*[F.max(F.when(F.col("variabl") == c, F.col("slot"))).alias(f"{c}__slot") for c in cols])
    return df.join(slots, key, "left")


def group_rare_levels(df: DataFrame, movers: DataFrame, cols: list[str], suffix: str = "__grpd", key: str = "Rww_ID") -> DataFrame:
    """Add ``<col>__grpd``: the level when (col, level) is a significant level,
    else ' ALL OTHERS' (a missing level too).  Fitted on training statistics,
    applied to any frame, for all columns in one step."""
    found = with_slots(df, level_dictionary(movers), cols, key)
    grouped = [F.when(F.col(f"{c}__slot").isNotNull(), F.col(c).cast("string")).otherwise(F.lit(ALL_OTHERS_GROUPED)).alias(c + suffix)
               for c in cols]
    return found.select(*df.columns, *grouped)


def one_hot_long(df: DataFrame, key: str, cols: list[str], levels: DataFrame, sep: str,
                 strip_suffix: str = "") -> DataFrame:
    """Sparse long form of a one-hot encoding: (key, dummy) for every indicator
    equal to 1.  ``levels`` is (variabl, ctgry_lvl) of the encoded levels
    (fitted on training rows); levels not in it encode as all zeros."""
    lv = long_levels(df, cols, [key])
    enc = sized_broadcast(levels.select("variabl", "ctgry_lvl").distinct())
    hit = lv.join(enc, ["variabl", "ctgry_lvl"], "inner")
    prefix = (F.expr(f"substring(variabl, 1, length(variabl) - {len(strip_suffix)})")
              if strip_suffix else F.col("variabl"))
    return hit.select(key, F.concat(prefix, F.lit(sep), F.regexp_replace("ctgry_lvl", " ", "_")).alias("dummy"))
