"""Level statistics as a state that later batches add to.

A state has one row per (variable, level): counts, exact sums, extremes and a
quantile sketch.  States of two batches merge into that of their union without
the rows of either, so a new batch of orders costs its own rows plus the levels.
Sums are whole units (seconds of a duration in days), so merging in any order
gives the same numbers; the sketch keeps ranks within a known share of the rows.

Distinct counts work alike: one sketch of the level names for each variable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .levels import long_levels

KEYS = ["variabl", "ctgry_lvl"]
SKETCH_K = 800  # quantile sketch: single-sided rank error about 0.3 % of the rows at 99 % confidence
RANK_ERROR = 0.006  # what is promised for a merged sketch
LOG_REGISTERS = 14  # distinct counts: 2^14 registers
DISTINCT_ERROR = 3 * 1.04 / 2 ** (LOG_REGISTERS / 2)  # three standard errors


def level_state(df: DataFrame, cols: list[str], target: str, unit: float) -> DataFrame:
    """State of one batch: nbr, total, squares (in whole ``unit`` parts of ``target``), low, high, sketch."""
    rows = long_levels(df.where(F.col(target).isNotNull()), cols, [target])
    whole = F.round(F.col(target) * unit).cast("decimal(20,0)")
    return rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("nbr"), F.sum(whole).cast("decimal(38,0)").alias("total"),
        F.sum((whole * whole).cast("decimal(38,0)")).cast("decimal(38,0)").alias("squares"),
        F.min(target).alias("low"), F.max(target).alias("high"),
        F.kll_sketch_agg_double(F.col(target).cast("double"), F.lit(SKETCH_K)).alias("sketch"))


def merge_states(*states: DataFrame) -> DataFrame:
    """The state of all batches together."""
    return reduce(DataFrame.unionByName, states).groupBy(*KEYS).agg(
        F.sum("nbr").alias("nbr"), F.sum("total").cast("decimal(38,0)").alias("total"),
        F.sum("squares").cast("decimal(38,0)").alias("squares"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("sketch"))


def state_stats(state: DataFrame, unit: float, ps: list[float]) -> DataFrame:
    """variabl, ctgry_lvl, nbr, lvl_mean, lvl_std, lvl_min, lvl_max and ``q`` (a value for each of ``ps``)."""
    n = F.col("nbr").cast("decimal(18,0)")
    # n * squares - total^2 in whole numbers: nothing cancels
    spread = (n * F.col("squares")).cast("decimal(38,0)") - (F.col("total") * F.col("total")).cast("decimal(38,0)")
    variance = spread.cast("double") / (F.col("nbr").cast("double") * (F.col("nbr") - 1))
    return state.select(
        *KEYS, "nbr", (F.col("total").cast("double") / F.col("nbr") / unit).alias("lvl_mean"),
        F.when(F.col("nbr") > 1, F.sqrt(variance) / unit).alias("lvl_std"), F.col("low").alias("lvl_min"), F.col("high").alias("lvl_max"),
        F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))) for p in ps]).alias("q"))


def rank_gap(below: Column, upto: Column, n: Column, p: float) -> Column:
    """How far rank ``p`` is from the ranks that a value takes, as a share of the rows:
    ``below`` rows are smaller than the value, ``upto`` no larger."""
    at = n * F.lit(float(p))
    return F.greatest(below - at, at - upto, F.lit(0.0)) / n


def distinct_state(df: DataFrame, cols: list[str]) -> DataFrame:
    """variabl, levels: a sketch of each variable's level names."""
    return long_levels(df, cols, []).groupBy("variabl").agg(F.hll_sketch_agg("ctgry_lvl", F.lit(LOG_REGISTERS)).alias("levels"))


def merge_distinct(*states: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, states).groupBy("variabl").agg(F.hll_union_agg("levels").alias("levels"))


def distinct_estimate(state: DataFrame) -> DataFrame:
    """variabl, nbr_lvls_est and its bounds low_est and high_est (three standard errors, and one either way)."""
    n = F.hll_sketch_estimate("levels")
    return state.select("variabl", n.alias("nbr_lvls_est"), (n * (1 - DISTINCT_ERROR) - 1).alias("low_est"),
                        (n * (1 + DISTINCT_ERROR) + 1).alias("high_est"))
