import math

import duckdb
import pytest
from pyspark.sql import functions as F

from shipcast.operators import sampling as S


def test_key_hash_matches_sql(spark):
    keys = [0, 1, 2, 12345, 2**40 + 7, 2147483646, 2147483647, 9_000_000_000_000]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = [r[0] for r in df.select(S.key_hash("k", 42)).collect()]
    con = duckdb.connect()
    want = [con.execute(f"SELECT {S.key_hash_sql(str(k), 42)}").fetchall()[0][0] for k in keys]
    assert got == want
    assert all(0 <= h < S.MODULUS for h in got)


def test_hash_split_exact_partition(spark):
    n = 1003
    df = spark.range(n).withColumnRenamed("id", "k")
    marked = S.hash_split(df, "k", 0.25, seed=42).collect()
    test = {r.k for r in marked if r.is_test == 1}
    assert len(marked) == n and len(test) == math.ceil(0.25 * n)
    hs = sorted(((r.h, r.k) for r in df.select(S.key_hash("k", 42).alias("h"), "k").collect()))
    assert test == {k for _, k in hs[: math.ceil(0.25 * n)]}   # brute force: the smallest hashes


def test_kth_smallest_with_hash_ties(spark):
    # keys congruent mod 2^31-1 share a hash: ties must break by key
    keys = [5, 5 + S.MODULUS, 5 + 2 * S.MODULUS, 6, 7]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    hs = sorted((r.h, r.k) for r in df.select(S.key_hash("k", 3).alias("h"), "k").collect())
    for k in range(1, len(keys) + 1):
        assert S.kth_smallest(df, "k", k, 3) == hs[k - 1]
    assert S.kth_smallest(df, "k", 0, 3) is None


def test_undersample_balanced_sizes(spark):
    rows = [(i, 1 if i % 10 == 0 else 0) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, y int")
    us = S.undersample_balanced(df, "y", "k", seed=9).collect()
    by = {}
    for r in us:
        by[(r.sample_part, r.y)] = by.get((r.sample_part, r.y), 0) + 1
    assert by == {("train", 1): 30, ("test", 1): 10, ("train", 0): 30, ("test", 0): 10}
    assert len({r.k for r in us}) == len(us)


def test_undersample_too_few_majority(spark):
    df = spark.createDataFrame([(i, 1 if i < 8 else 0) for i in range(10)], "k long, y int")
    with pytest.raises(ValueError):
        S.undersample_balanced(df, "y", "k")


def test_seeds_give_independent_samples(spark):
    n = 40000
    df = spark.range(n).withColumnRenamed("id", "k")
    picked = {}
    for seed in (7, 8, 42, 43):
        rows = S.hash_split(df, "k", 0.25, seed=seed).where("is_test = 1").select("k").collect()
        picked[seed] = {r.k for r in rows}
        assert len(rows) == n // 4
    for a, b in ((7, 8), (42, 43), (7, 42)):
        assert abs(len(picked[a] & picked[b]) / (n // 4) - 0.25) < 0.03
