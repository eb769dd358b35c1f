"""Scans of the driver-provided parquet tables.

Reads are lazy; Catalyst prunes columns and pushes filters into the parquet
scan, so callers simply select what they need.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


@dataclass(frozen=True)
class Tables:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")

    @property
    def nation(self) -> DataFrame:
        return self.table("nation")

    @property
    def customer(self) -> DataFrame:
        return self.table("customer")

    @property
    def supplier(self) -> DataFrame:
        return self.table("supplier")

    @property
    def part(self) -> DataFrame:
        return self.table("part")

    @property
    def orders(self) -> DataFrame:
        return self.table("orders")

    @property
    def lineitem(self) -> DataFrame:
        return self.table("lineitem")


def load_tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)


def sized_broadcast(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast ``df`` only after proving it has at most ``max_rows`` rows.

    The probe is a plain count (one number per task; a limit would send up to
    ``max_rows`` rows of every partition to one task); above the bound the
    frame is returned untouched so the planner (and AQE at runtime) chooses a
    shuffle join instead.
    """
    return F.broadcast(df) if df.count() <= max_rows else df
