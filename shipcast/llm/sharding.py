"""Operator 5: a uniform shuffle into shards of exact sizes.

The rows of every source block go to the shards in numbers drawn beforehand: the
communication matrix (blocks x shards) is multivariate hypergeometric, which is
the law of a uniform permutation's counts given the block and shard sizes.  Then
each block permutes its rows, sends consecutive runs of them to the shards, and
each shard permutes what it got; the row's place there is its slot.

Only counts reach the driver: at most ``MAX_BLOCKS`` x shards numbers.  Inside a
shard, the second permutation is spread over cells of about ``CELL_ROWS`` rows:
a row's random key picks its cell, and slots continue from cell to cell.
Random keys are stored with the rows, so tasks that run again see the same ones.
DataFrame functions only.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

MAX_BLOCKS = 8192
CELL_ROWS = 4096


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` items, taken from good + bad without return, are good.

    Inverts the distribution outwards from its mode, so the steps are about the
    standard deviation; totals are exact at any size.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    p_mode = math.exp(_log_choose(good, mode) + _log_choose(bad, draws - mode) - _log_choose(good + bad, draws))
    u = rng.random() - p_mode
    up, down, p_up, p_down = mode, mode, p_mode, p_mode
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Random counts with these row and column sums, as a uniform permutation has them."""
    if sum(blocks) != sum(shards):
        raise ValueError("blocks and shards hold different numbers of rows")
    rng, left = random.Random(seed), list(shards)
    matrix = []
    for n in blocks:
        row, rest = [], sum(left)
        for s, room in enumerate(left):
            rest -= room
            row.append(hypergeometric(rng, room, rest, n))
            n -= row[-1]
            left[s] -= row[-1]
        matrix.append(row)
    return matrix


def shuffle_into_shards(rows: DataFrame, n_shards: int, seed: int = 0) -> DataFrame:
    """``rows`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in its shard).

    Every assignment of rows to places is equally likely; shard sizes differ by
    one at most.  Repeated rows are rows like others; all columns are kept.  Input
    columns named shard or slot are replaced.
    """
    spark, kept = rows.sparkSession, [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    keyed = common.stored(rows.select(
        F.struct(*kept).alias("row"), F.pmod(F.spark_partition_id(), F.lit(MAX_BLOCKS)).alias("block"),
        F.rand(seed).alias("first"), F.rand(seed + 1).alias("second")), "shard-keys")
    sizes = sorted((r[0], r[1]) for r in keyed.groupBy("block").count().collect())  # at most MAX_BLOCKS
    n = sum(c for _, c in sizes)
    shards = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    matrix = communication_matrix([c for _, c in sizes], shards, seed)
    upto = [(b, [sum(row[:s + 1]) for s in range(n_shards)]) for (b, _), row in zip(sizes, matrix)]
    plan = spark.createDataFrame(upto, "block int, upto array<bigint>")

    n_cells = max(1, -(-n // (n_shards * CELL_ROWS)))
    place = F.row_number().over(Window.partitionBy("block").orderBy("first", "second")) - 1
    sent = (keyed.withColumn("place", place).join(F.broadcast(plan), "block")  # at most MAX_BLOCKS rows
            .select("row", "second", F.size(F.filter("upto", lambda x: x <= F.col("place"))).alias("shard"),
                    F.least(F.floor(F.col("second") * n_cells), F.lit(n_cells - 1)).cast("int").alias("cell")))
    sent = common.stored(sent, "shard-sent")
    cells = sent.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "cell").orderBy("second")
    return (sent.withColumn("turn", F.row_number().over(order)).join(starts, ["shard", "cell"])
            .select("row.*", "shard", (F.col("start") + F.col("turn") - 1).alias("slot")))


def query(spark, sf_dir) -> DataFrame:
    """op5: all documents into 16 shards whose counts are at most one apart."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = common.documents(spark, sf_dir).select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"))
    return shuffle_into_shards(rows, 16, seed=20).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
