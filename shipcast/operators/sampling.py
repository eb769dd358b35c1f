"""Deterministic key-hash sampling: exact-size splits and balanced undersampling.

Row order in a distributed frame is not stable, so samples are defined by a
portable integer hash of a unique key: a row belongs to the sample of size k
when its (hash, key) is among the k smallest.  The k-th smallest pair is found
without sorting the data set: a 65,536-bucket histogram of the hash (one
aggregate job, bounded output) locates the bucket holding the k-th row, a
second histogram of exact hash values inside that bucket locates the hash, and
only rows sharing that single hash value are ordered by key.  Every job is an
aggregation whose result size is bounded independently of the data.

The hash uses only ``%``, ``*`` and ``+`` on 64-bit integers with operands
kept below 2^31, so it never overflows and the same rule written in SQL
selects the same rows.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the key hash (a Lehmer step, a quadratic step, a Lehmer step
# modulo the Mersenne prime 2^31 - 1).  Changing them changes every sample.
MODULUS = 2147483647
MULT_1 = 48271
MULT_2 = 69621
SEED_STEP = 40692
_BUCKET_BITS = 15


def key_hash(key: str | Column, seed: int) -> Column:
    """Integer hash in [0, 2^31 - 1) of a bigint key.

    The seed is added before the quadratic step, so the orders of two seeds
    differ by a term that depends on the key: their samples are independent.
    """
    k = F.col(key) if isinstance(key, str) else key
    x1 = (F.pmod(k.cast("bigint"), F.lit(MODULUS)) * MULT_1 + _shift(seed)) % MODULUS
    x2 = x1 * x1 % MODULUS
    return x2 * MULT_2 % MODULUS


def _shift(seed: int) -> int:
    """Where a seed starts: spread over the modulus, so near seeds are far apart."""
    return (seed + 1) * SEED_STEP % MODULUS * SEED_STEP % MODULUS


def key_hash_sql(key: str, seed: int) -> str:
    """The same hash as DuckDB SQL text (used by the oracle)."""
    x1 = f"((((CAST({key} AS BIGINT) % {MODULUS}) + {MODULUS}) % {MODULUS}) * {MULT_1} + {_shift(seed)}) % {MODULUS}"
    x2 = f"(({x1}) * ({x1})) % {MODULUS}"
    return f"(({x2}) * {MULT_2} % {MODULUS})"


class HashRanks:
    """Rank structure of a frame's (hash, key) pairs for exact-k selection.

    Built with one pass over the frame (a 65,536-bucket histogram of the
    hash, which also yields the row count); the narrow (hash, key) projection
    is persisted so later selection passes do not recompute the lineage.
    Call ``release`` when done.
    """

    def __init__(self, df: DataFrame, key: str, seed: int):
        self.seed = seed
        self.key = key
        self.hk = (df.select(key_hash(key, seed).alias("h"), F.col(key).alias("k"))
                   .persist(StorageLevel.MEMORY_AND_DISK))
        self.buckets = sorted(tuple(r) for r in self.hk.groupBy(F.shiftright("h", _BUCKET_BITS).alias("b"))
                              .agg(F.count(F.lit(1)).alias("n")).collect())
        self.n = sum(n for _, n in self.buckets)

    def bound(self, k: int) -> tuple[int, int] | None:
        """(hash, key) of the k-th smallest pair; None when k < 1."""
        if k < 1:
            return None
        if k > self.n:
            raise ValueError(f"sample of {k} rows requested from {self.n} rows")
        remaining = k
        for b, n in self.buckets:
            if remaining <= n:
                break
            remaining -= n
        values = sorted(tuple(r) for r in self.hk.where(F.shiftright("h", _BUCKET_BITS) == b)
                        .groupBy("h").agg(F.count(F.lit(1)).alias("n")).collect())
        for hv, n in values:
            if remaining <= n:
                break
            remaining -= n
        last_key = (self.hk.where(F.col("h") == hv).orderBy("k").limit(remaining)
                    .agg(F.max("k")).collect()[0][0])
        return int(hv), int(last_key)

    def flag(self, bound: tuple[int, int] | None) -> Column:
        """1 for rows whose (hash, key) is at or below ``bound``."""
        return _within(key_hash(self.key, self.seed), F.col(self.key), bound).cast("int")

    def release(self) -> None:
        self.hk.unpersist()


def kth_smallest(df: DataFrame, key: str, k: int, seed: int) -> tuple[int, int] | None:
    """(hash, key) of the k-th smallest (hash, key) pair of ``df`` (unique key)."""
    ranks = HashRanks(df, key, seed)
    try:
        return ranks.bound(k)
    finally:
        ranks.release()


def _within(h: Column, key: Column, bound: tuple[int, int] | None) -> Column:
    if bound is None:
        return F.lit(False)
    th, tk = bound
    return (h < th) | ((h == th) & (key <= tk))


def hash_split(df: DataFrame, key: str, test_fraction: float, seed: int = 42,
               exact: bool = True, flag: str = "is_test") -> DataFrame:
    """Add ``flag`` (1 = test row).

    exact=True: exactly ceil(test_fraction * n) test rows (the smallest hashes).
    exact=False: a Bernoulli-like threshold on the hash, no extra jobs.
    """
    if not exact:
        return df.withColumn(flag, (key_hash(key, seed) < int(test_fraction * MODULUS)).cast("int"))
    ranks = HashRanks(df, key, seed)
    try:
        bound = ranks.bound(math.ceil(test_fraction * ranks.n))
    finally:
        ranks.release()
    return df.withColumn(flag, ranks.flag(bound))


def undersample_balanced(train: DataFrame, label: str, key: str, test_fraction: float = 0.25,
                         seed: int = 7) -> DataFrame:
    """Balanced sample: minority rows (label 1) split train/test; majority rows
    sampled to exactly the same sizes.  Adds ``sample_part`` ('train' | 'test').

    The majority test part takes the hash ranks right after the train part, so
    the two parts never overlap.
    """
    minority = train.where(F.col(label) == 1)
    majority = train.where(F.col(label) == 0)
    min_ranks = HashRanks(minority, key, seed)
    maj_ranks = HashRanks(majority, key, seed + 1)
    try:
        n_min = min_ranks.n
        n_min_test = math.ceil(test_fraction * n_min)
        n_min_train = n_min - n_min_test
        if n_min > maj_ranks.n:
            raise ValueError(f"majority class has {maj_ranks.n} rows, fewer than the {n_min} minority rows")
        b_min_test = min_ranks.bound(n_min_test)
        b_train = maj_ranks.bound(n_min_train)
        b_all = maj_ranks.bound(n_min)
    finally:
        min_ranks.release()
        maj_ranks.release()
    min_marked = minority.withColumn(
        "sample_part", F.when(min_ranks.flag(b_min_test) == 1, "test").otherwise("train"))
    maj_marked = (majority.where(maj_ranks.flag(b_all) == 1)
                  .withColumn("sample_part", F.when(maj_ranks.flag(b_train) == 1, "train").otherwise("test")))
    return min_marked.unionByName(maj_marked)
