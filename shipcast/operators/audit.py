"""Timeline audit, cleaning filters and column profiles.

Each audit is a single aggregate pass: one ``agg`` evaluates every rule as a
conditional count, then ``stack`` turns the one-row result into long form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import timing

PTS, APPR = "order_purchase_timestamp", "order_approved_at"
CARR, DELIV = "order_delivered_carrier_date", "order_delivered_customer_date"
EST = "order_estimated_delivery_date"



def chronology_rules():
    """(rule name, predicate): the six chronology checks of the timeline audit."""
    return [
        ("purchase_after_approval", F.col(PTS) > F.col(APPR)),
        ("approval_after_carrier", F.col(APPR) > F.col(CARR)),
        ("purchase_after_carrier", F.col(PTS) > F.col(CARR)),
        ("carrier_not_before_customer", F.col(CARR) >= F.col(DELIV)),
        ("approval_after_customer", F.col(APPR) > F.col(DELIV)),
        ("purchase_after_customer", F.col(PTS) > F.col(DELIV)),
    ]


def _long_form(wide: DataFrame, names: list[str], key: str, value: str) -> DataFrame:
    return wide.unpivot([], names, key, value)


def chronology_violations(df: DataFrame) -> DataFrame:
    """(rule, n_rows): rows violating each chronology rule, in one pass."""
    rules = chronology_rules()
    wide = df.agg(*[F.count_if(cond).alias(name) for name, cond in rules])
    return _long_form(wide, [n for n, _ in rules], "rule", "n_rows")


def clean_timeline(df: DataFrame) -> DataFrame:
    """Keep delivered rows whose carrier / approval dates are present and ordered.

    Equal timestamps are kept (``<=``), unlike the ``>=`` used when counting.
    """
    return df.where(
        F.col(DELIV).isNotNull() & F.col(CARR).isNotNull() & (F.col(CARR) <= F.col(DELIV))
        & F.col(APPR).isNotNull() & (F.col(APPR) <= F.col(DELIV)) & (F.col(APPR) <= F.col(CARR)))


def delivered_with_dates(df: DataFrame) -> DataFrame:
    """The cleaning chain before the approval-order rule."""
    return df.where(F.col(DELIV).isNotNull() & F.col(CARR).isNotNull()
                    & (F.col(CARR) <= F.col(DELIV)) & F.col(APPR).isNotNull())


def suspect_approval_flag():
    return (F.col(APPR) > F.col(DELIV)) | (F.col(APPR) > F.col(CARR))


def suspect_approvals(df: DataFrame) -> DataFrame:
    """Rows approved after carrier hand-off or delivery vs the rest, with late
    counts (late = delivered after the estimate, no grace day)."""
    base = delivered_with_dates(df)
    return (base.groupBy(suspect_approval_flag().cast("int").alias("approval_suspect"))
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.sum(timing.late_flag(DELIV, EST, "strict")).alias("n_late")))


def null_census(df: DataFrame, only_positive: bool = True) -> DataFrame:
    """(column_name, n_null) for every column, in one aggregate pass."""
    cols = df.columns
    wide = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols])
    out = _long_form(wide, cols, "column_name", "n_null")
    return out.where(F.col("n_null") > 0) if only_positive else out


def profile_columns(df: DataFrame) -> DataFrame:
    """(column_name, data_type, non_null): schema plus a one-pass non-null count."""
    cols = df.columns
    wide = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in cols])
    counts = _long_form(wide, cols, "column_name", "non_null")
    types = df.sparkSession.createDataFrame(
        [(f.name, f.dataType.simpleString()) for f in df.schema.fields],
        "column_name string, data_type string")
    return counts.join(F.broadcast(types), "column_name")


def numeric_columns(df: DataFrame, exclude: list[str] | tuple[str, ...] = ()) -> list[str]:
    """Names of numeric columns, minus an exclusion list."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in set(exclude)]


def tail_rows(df: DataFrame, col: str, cutoff: float, cols: list[str], above: bool = True) -> DataFrame:
    """Rows beyond a cutoff, sorted by the column (for inspection)."""
    cond = F.col(col) > cutoff if above else F.col(col) < cutoff
    return df.where(cond).select(*cols).orderBy(col)
