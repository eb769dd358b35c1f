import collections
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from shipcast.llm import common, sharding

from . import helpers


def test_draws_follow_the_hypergeometric_law():
    rng, n = random.Random(1), 60000
    seen = collections.Counter(sharding.hypergeometric(rng, 7, 5, 6) for _ in range(n))
    for k in range(1, 7):
        p = math.comb(7, k) * math.comb(5, 6 - k) / math.comb(12, 6)
        assert abs(seen[k] / n - p) < 5 * math.sqrt(p * (1 - p) / n)
    assert sum(seen.values()) == n and min(seen) >= 1


def test_matrix_has_exact_margins_at_any_size():
    blocks, shards = [10**10, 3, 0, 5 * 10**9], [5 * 10**9 + 1] * 3
    matrix = sharding.communication_matrix(blocks, shards, 3)
    assert [sum(r) for r in matrix] == blocks and [sum(c) for c in zip(*matrix)] == shards
    assert sharding.communication_matrix([], [0, 0], 1) == []
    with pytest.raises(ValueError):
        sharding.communication_matrix([1], [2], 0)


def _valid(rows, n, n_shards):
    places = collections.defaultdict(list)
    for r in rows:
        places[r.shard].append(r.slot)
    assert sum(map(len, places.values())) == n
    sizes = [len(places[s]) for s in range(n_shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in places.values())


def test_awkward_rows_keep_their_columns(spark):
    docs = helpers.awkward(spark)
    rows = sharding.shuffle_into_shards(docs, 4, seed=1).collect()
    _valid(rows, len(helpers.AWKWARD), 4)
    assert sorted(str(r.text) for r in rows) == sorted(str(r[1]) for r in helpers.AWKWARD)
    assert sharding.shuffle_into_shards(helpers.empty(spark), 4).count() == 0


def test_many_cells(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 10)
    rows = sharding.shuffle_into_shards(spark.range(1003, numPartitions=7).withColumn("x", F.col("id") % 3), 5, 2).collect()
    _valid(rows, 1003, 5)


def test_places_are_uniform(spark):
    """Over many seeds, a row's shard does not depend on its block."""
    hits = collections.Counter()
    for seed in range(12):
        for r in sharding.shuffle_into_shards(spark.range(400, numPartitions=4), 4, seed).collect():
            hits[r.id // 100, r.shard] += 1
    chi = sum((hits[b, s] - 300) ** 2 / 300 for b in range(4) for s in range(4))
    assert chi < 40  # 9 degrees of freedom


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    df = sharding.query(spark, sf)
    rows = df.collect()
    texts = {r.doc_id: r.text for r in common.documents(spark, sf).collect()}
    _valid(rows, len(texts), 16)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)


def test_no_python_in_the_plan(spark):
    plan = sharding.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
