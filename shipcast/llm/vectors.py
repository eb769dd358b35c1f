"""Helpers of the vector operators: usable rows, samples, dealing searches to blocks of rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 4096
SEARCHES = 2048  # searches that one task holds against a block of rows


def finite(vector) -> Column:
    """Whether a vector is there and holds neither null, NaN nor infinity."""
    v = F.col(vector) if isinstance(vector, str) else vector
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & good


def matrix(column) -> np.ndarray:
    """List column of equally long rows as an array of rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1 if n else 0)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The reverse of ``matrix``."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * width, pa.array(rows.ravel(), type=kind))


def sample(rows: DataFrame, by: str, vector: str, limit: int = SAMPLE_ROWS) -> np.ndarray:
    """The vectors of the ``limit`` rows with the least hash of ``by``, as float64."""
    picked = (rows.select(F.xxhash64(by).alias("order"), F.col(vector).cast("array<double>").alias("v"))
              .orderBy("order", "v").limit(limit).collect())
    return np.array([r["v"] for r in picked], dtype=np.float64)


def lengths(rows: DataFrame, vector: str) -> list[tuple[int, int]]:
    """(length, number of rows) of the vectors; a few rows, as vectors of one table are of one kind."""
    return [tuple(r) for r in rows.groupBy(F.size(vector).alias("d")).count().orderBy("d").collect()]


def against_blocks(rows: DataFrame, searches: DataFrame, keys: list[str], func: Callable, schema: str,
                   most: int = SEARCHES) -> DataFrame:
    """``func(rows of a block, searches of it)`` for each block named by ``keys`` of both sides.

    Blocks are bounded by whoever made the keys.  A block with more than ``most``
    searches is dealt again for each part of them, so that no task holds more.
    """
    asked = searches.groupBy(*keys).agg(F.count(F.lit(1)).alias("asked_"))
    parts = asked.select(*keys, F.ceil(F.col("asked_") / most).cast("int").alias("parts_"))
    left = (rows.join(parts, keys).withColumn("part_", F.explode(F.sequence(F.lit(0), F.col("parts_") - 1)))
            .drop("parts_"))
    right = (searches.join(parts, keys)
             .withColumn("part_", F.pmod(F.xxhash64(*[c for c in searches.columns if c not in keys]), F.col("parts_")).cast("int"))
             .drop("parts_"))
    both = [*keys, "part_"]
    return left.groupBy(*both).cogroup(right.groupBy(*both)).applyInArrow(func, schema)
