"""Train-fitted preparation: mean imputation, outlier rules, standardisation.

Order matters and is the caller's: impute (means include outliers) -> drop
outliers -> standardise (mean / sample std of the cleaned training rows).
Every fitted statistic is a one-row aggregate of the training frame joined
back as a broadcast (exactly one row), so nothing is collected and the plan
stays lazy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.variables import DISTANCE_MAX_KM, SHIP_MISS_TRIM


def _stats(train: DataFrame, cols: list[str], with_std: bool) -> DataFrame:
    aggs = [F.avg(F.col(c).cast("double")).alias(f"_m_{c}") for c in cols]
    if with_std:
        aggs += [F.stddev_samp(F.col(c).cast("double")).alias(f"_s_{c}") for c in cols]
    return F.broadcast(train.agg(*aggs))  # exactly one row


def _apply(df: DataFrame, stats: DataFrame, cols: list[str], expr) -> DataFrame:
    others = [c for c in df.columns if c not in set(cols)]
    return df.crossJoin(stats).select(*others, *[expr(c).alias(c) for c in cols])


def impute_mean(train: DataFrame, others: list[DataFrame], cols: list[str]) -> list[DataFrame]:
    """Fill missing ``cols`` with the training mean, in train and in each other
    frame (the training mean is used everywhere).  Columns become double."""
    st = _stats(train, cols, with_std=False)
    fill = lambda c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}"))
    return [_apply(d, st, cols, fill) for d in [train, *others]]


def drop_outliers(df: DataFrame, ship_miss_min: float = SHIP_MISS_TRIM,
                  distance_max: float = DISTANCE_MAX_KM) -> DataFrame:
    """Keep shipping_limit_miss_amt >= -60 days and distance_km < 3400 km."""
    return df.where((F.col("shipping_limit_miss_amt") >= ship_miss_min) & (F.col("distance_km") < distance_max))


def standardize(train: DataFrame, others: list[DataFrame], cols: list[str]) -> list[DataFrame]:
    """(x - mean) / sample std with training statistics; a constant training
    column (std 0) scales to 0, as MLlib's StandardScaler does."""
    st = _stats(train, cols, with_std=True)

    def scale(c):
        centred = F.col(c).cast("double") - F.col(f"_m_{c}")
        return F.when(F.col(f"_s_{c}") == 0, F.lit(0.0)).otherwise(centred / F.col(f"_s_{c}"))

    return [_apply(d, st, cols, scale) for d in [train, *others]]
