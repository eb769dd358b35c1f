"""Named datasets of the three analyses, built lazily from the base tables.

Every function returns a lazy DataFrame; nothing is collected.  The frames
compose: items -> item features -> clean items; orders -> order features ->
complete cases -> train/test split.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, features, sampling
from ..session import stored_table
from ..sources import fixtures
from ..sources.tables import load_tables

SEED_SPLIT = 42
TEST_FRACTION = 0.25


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.orders_enriched(load_tables(spark, sf_dir))


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.order_features(orders(spark, sf_dir))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.item_features(fixtures.order_items(load_tables(spark, sf_dir)))


def clean_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.clean_timeline(items(spark, sf_dir))


def timeline_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``items`` with dates, durations and late flag only: no product, place or payment."""
    return features.timeline_features(fixtures.item_timeline(load_tables(spark, sf_dir)))


def clean_timeline_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.clean_timeline(timeline_items(spark, sf_dir))


def reg_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.complete_cases(order_features(spark, sf_dir), features.REG_COMPLETE_CASE_COLS)


def clf_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.complete_cases(order_features(spark, sf_dir), features.CLF_COMPLETE_CASE_COLS)


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exact 75/25 key-hash split (test = ceil(0.25 n) rows)."""
    marked = sampling.hash_split(df, "Rww_ID", TEST_FRACTION, seed=SEED_SPLIT)
    return (marked.where("is_test = 0").drop("is_test"), marked.where("is_test = 1").drop("is_test"))


def _stored_cases(spark: SparkSession, sf_dir: str, complete: list[str], cols: list[str] | None, name: str) -> DataFrame:
    """The rows with no missing value in ``complete``, stored once: all columns, or the key and ``cols``.

    Whether a row is complete is stored beside it and read back.  A filter before the write
    would be pushed below the features it tests, which would then be computed twice.  Missing
    values are counted, since the parts of an ``and`` share no step of a date's computation.
    """
    rows = order_features(spark, sf_dir)
    here = functools.reduce(operator.add, [F.col(c).isNull().cast("int") for c in complete]) == 0
    kept = rows.columns if cols is None else list(dict.fromkeys(["Rww_ID", *cols]))
    return stored_table(rows.select(*kept, here.alias("_complete")), name).where("_complete").drop("_complete")


def reg_split(spark: SparkSession, sf_dir: str, cols: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Train and test rows; the complete cases are stored once, so that the split, the fits
    on the training rows and their application read them instead of the tables.

    ``cols``: the columns that the caller reads, the key aside (default: all); others are not stored."""
    return split(_stored_cases(spark, sf_dir, features.REG_COMPLETE_CASE_COLS, cols, "reg-cases"))


def clf_split(spark: SparkSession, sf_dir: str, cols: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """As ``reg_split``."""
    return split(_stored_cases(spark, sf_dir, features.CLF_COMPLETE_CASE_COLS, cols, "clf-cases"))


# columns that the outlier rules read
OUTLIER_COLS = ["shipping_limit_miss_amt", "distance_km"]


def clf_prepared(spark: SparkSession, sf_dir: str, cols: list[str] | None = None,
                 parts: tuple[DataFrame, DataFrame] | None = None, keep: list[str] = ()):
    """Classifier frames after impute -> outlier drop -> standardise (train-fitted): the key,
    the target, ``cols`` and ``keep``.

    ``parts``: the train and test rows of ``clf_split``, where the caller has them already.
    Returns (train_imputed, test_imputed, train_clean, test_clean, train_scaled, test_scaled).
    """
    from ..operators import prep
    from . import variables as V
    cols = cols or V.CLF_BASIC
    train, test = parts or clf_split(spark, sf_dir, [V.CLF_TARGET, *cols, *OUTLIER_COLS, *keep])
    train_i, test_i = prep.impute_mean(train, [test], cols)
    train_o, test_o = prep.drop_outliers(train_i), prep.drop_outliers(test_i)
    scaled = [c for c in cols if c not in V.CLF_NOT_SCALED]
    train_s, test_s = prep.standardize(train_o, [test_o], scaled)
    return train_i, test_i, train_o, test_o, train_s, test_s
