"""Operators on embeddings against brute force."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shipcast.llm import common, hash_forest, multi_index, zone_clusters

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def clustered(n=1500, dim=64, seed=3):
    """A third near one point, some exact copies, the rest in a few clusters."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    at = np.where(rng.random(n) < 0.33, 0, rng.integers(0, 12, n))
    rows = centres[at] + rng.standard_normal((n, dim)) * 0.15
    rows[rng.random(n) < 0.1] = rows[0]
    return rows.astype(np.float32), (at % 10).astype(int)


def frame(spark, rows, labels=None, ids=None):
    labels = [0] * len(rows) if labels is None else labels
    ids = range(len(rows)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(x) for x in r], int(k)) for i, r, k in zip(ids, rows, labels)], SCHEMA)


def awkward(spark, dim=64):
    good = np.eye(dim, dtype=float)
    rows = [(0, good[0].tolist(), 1), (50, good[1].tolist(), 2), (100, (good[0] * 2).tolist(), 1), (3, None, 1), (4, [], 1),
            (5, [None] * dim, 1), (6, [NAN] + [0.0] * (dim - 1), 1), (7, [INF] + [0.0] * (dim - 1), 2),
            (8, [0.0] * dim, None), (9, good[0].tolist(), 1), (9, good[0].tolist(), 1), (None, good[2].tolist(), 3),
            (150, [1.0, 2.0], 1), (11, [2.0, 1.0], 1), (-100, (good[0] + good[1]).tolist(), 2), (200, [0.0] * dim, 4)]
    df = spark.createDataFrame(rows, SCHEMA)
    names = ["sid", "key", "place", "ids", "vec", "cell", "tree", "hash", "block", "score", "rank", "n", "curve", "rows_", "low"]
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(names)))


def load(spark, sf=SF):
    rows = common.documents(spark, sf, "embeddings").orderBy("vec_id").collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float), np.array([r.label for r in rows])


# --- operator 11

def true_nearest(ids, rows, modulus=50, k=5):
    units = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    for i in np.flatnonzero(ids % modulus == 0):
        scores = units @ units[i]
        order = [j for j in np.lexsort((ids, -np.round(scores, 12))) if ids[j] != ids[i]][:k]
        yield int(ids[i]), [int(ids[j]) for j in order], scores[order]


def found_by_query(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return found


def recall_of(found, ids, rows, modulus=50):
    hit = total = 0
    for q, want, _ in true_nearest(ids, rows, modulus):
        hit += len(set(want) & {v for _, v, _ in found[q]})
        total += len(want)
    return hit / total


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_of_the_query(spark, sf):
    ids, rows, _ = load(spark, f"/root/testdata/sf{sf}")
    found = found_by_query(hash_forest.query(spark, f"/root/testdata/sf{sf}"))
    assert recall_of(found, ids, rows) >= 0.9
    units = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    for q, near in found.items():
        assert [r for r, _, _ in near] == [1, 2, 3, 4, 5]
        assert near == sorted(near, key=lambda x: (-x[2], x[1]))
        for _, v, score in near:
            assert abs(score - units[ids == v][0] @ units[ids == q][0]) < 1e-12


@pytest.mark.parametrize("block_rows", [8192, 100])
def test_search_of_all_candidates_is_exact(spark, block_rows):
    """Small blocks: several cells, sliced hot cells, levels above the cells."""
    rows, _ = clustered(700)
    found = found_by_query(hash_forest.nearest_neighbours(frame(spark, rows), candidates=10**9, block_rows=block_rows, trees=2))
    for q, want, scores in true_nearest(np.arange(len(rows)), rows.astype(float)):
        assert [v for _, v, _ in found[q]] == want
        assert np.allclose([s for _, _, s in found[q]], scores, atol=1e-12)


def test_counts_and_levels_of_split_cells_equal_those_of_one_array(spark):
    rows, _ = clustered(900)
    df = frame(spark, rows)
    forest = hash_forest.Forest(rows[:200].astype(float), 64, 3)
    nodes = df.select(F.array("vec_id").alias("ids"), F.col("embedding").alias("vec")).cache()
    asked = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("sid"), F.col("embedding").alias("vec")).cache()
    strings = forest.hashes(rows.astype(float))
    for block_rows in (8192, 60):
        search = hash_forest._Search(nodes, asked, forest, len(rows), block_rows)
        counts = search.level_counts().cache()
        have = {r.sid: np.array(r.counts) for r in counts.collect()}
        if search.depth:
            for r in search.coarse_counts(asked.select("sid")).collect():
                have[r.sid][r.level] = r.n
        levels = {r.sid: r.level for r in search.levels(counts, 300).collect()}
        for q in have:
            shared = hash_forest._shared_bits(strings, strings[q][None, :])
            want = [(shared >= x).sum() for x in range(hash_forest.BITS + 1)]
            assert have[q].tolist() == want
            assert levels[q] == max([x for x, n in enumerate(want) if n >= 300], default=0)


def test_shared_bits_of_strings():
    a = np.array([0, 1, 1 << 62, (1 << 63) - 1, 5, (1 << 62) - 1], dtype=np.int64)
    b = np.array([0, 0, 0, (1 << 63) - 2, 7, 0], dtype=np.int64)
    want = [63 - (x ^ y).bit_length() for x, y in zip(a.tolist(), b.tolist())]
    assert hash_forest._shared_bits(a, b).tolist() == want


def test_forest_on_awkward_rows_and_empty_table(spark):
    found = found_by_query(hash_forest.nearest_neighbours(awkward(spark)))
    assert [v for _, v, _ in found[0]] == [9, 100, -100, 50]
    assert [v for _, v, _ in found[100]] == [0, 9, -100, 50]
    assert [v for _, v, _ in found[50]] == [-100, 0, 9, 100]
    assert [(v, round(s, 12)) for _, v, s in found[150]] == [(11, 0.8)]
    assert set(found) == {0, 50, 100, 150, -100}
    assert hash_forest.nearest_neighbours(awkward(spark).limit(0)).collect() == []


# --- operator 12

def lloyd(ids, numbers, k=16, rounds=3):
    first = sorted(range(len(ids)), key=lambda i: hashlib.sha256(f"1:{ids[i]}".encode()).hexdigest())[:k]
    centroids = numbers[first]

    def assign():
        d = ((numbers[:, None, :] - centroids[None]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        at, _ = assign()
        centroids = np.array([numbers[at == c].sum(axis=0) // (at == c).sum() if (at == c).any() else centroids[c]
                              for c in range(len(centroids))])
    at, d = assign()
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return sorted((int(i), int(c), int(x), int(d[at == c].sum()), int(d.sum()), digests[c]) for i, c, x in zip(ids, at, d))


def test_clusters_of_the_query(spark):
    ids, rows, _ = load(spark)
    assert sorted(tuple(r) for r in zone_clusters.query(spark, SF).collect()) == lloyd(ids, np.floor(rows * 64).astype(int))


def test_clusters_of_small_blocks_and_large_numbers(spark):
    rows, _ = clustered(600)
    rows[:100] *= 40000  # beyond whole sums in doubles
    got = zone_clusters.cluster(frame(spark, rows), block_rows=16)
    assert sorted(tuple(r) for r in got.collect()) == lloyd(np.arange(600), np.floor(rows.astype(float) * 64).astype(int))


def test_box_bounds_prune_and_keep_the_nearest():
    rng = np.random.default_rng(0)
    pruned = 0
    for _ in range(200):
        rows = rng.integers(-20, 20, 6)[None, :] + rng.integers(0, 5, (30, 6))
        centroids = rng.integers(-25, 25, (8, 6))
        low, high = rows.min(axis=0), rows.max(axis=0)
        least, most = zone_clusters.box_bounds(low, high, centroids)
        d = ((rows[:, None, :] - centroids[None]) ** 2).sum(axis=2)
        assert (least <= d.min(axis=0)).all() and (most >= d.max(axis=0)).all()
        pruned += (least > most.min()).sum()
        at, near = zone_clusters.nearest(rows, low, high, centroids)
        assert (at == d.argmin(axis=1)).all() and (near == d.min(axis=1)).all()
    assert pruned > 400


@given(st.sampled_from([(2, 3), (3, 2), (4, 2), (2, 4), (1, 3)]))
@settings(deadline=None, max_examples=10)
def test_hilbert_neighbours_differ_by_one_step(shape):
    dim, bits = shape
    grid = np.array(np.meshgrid(*[range(1 << bits)] * dim)).reshape(dim, -1).T
    index = zone_clusters.hilbert_index(grid, bits)
    place = index.astype(int) @ (1 << np.arange(index.shape[1])[::-1])
    assert sorted(place.tolist()) == list(range(len(grid)))
    walk = grid[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_clusters_on_awkward_rows_and_empty_table(spark):
    got = [tuple(r) for r in zone_clusters.cluster(awkward(spark)).collect()]
    kept = [r for r in awkward(spark).collect() if r.embedding is not None and len(r.embedding) == 64
            and all(x is not None and np.isfinite(x) for x in r.embedding)]
    assert sorted(map(str, (r[0] for r in got))) == sorted(map(str, (r.vec_id for r in kept)))
    assert all(r[2] == 0 and r[4] == 0 for r in got)  # as many centroids as vectors
    assert zone_clusters.cluster(awkward(spark).limit(0)).collect() == []
    with pytest.raises(Exception, match="outside"):
        zone_clusters.cluster(frame(spark, np.full((2, 64), 1e9))).collect()


# --- operator 13

def mined(ids, numbers, labels, modulus=100):
    found = set()
    for i in np.flatnonzero(ids % modulus == 0):
        scores = numbers @ numbers[i]
        order = np.lexsort((ids, -scores))
        positives = [j for j in order if labels[j] == labels[i] and ids[j] != ids[i]][:5]
        rest = [j for j in order if labels[j] != labels[i]]
        for p in positives:
            fits = [j for j in rest if 30 * scores[p] <= 100 * scores[j] <= 90 * scores[p]][:10]
            found |= {(int(ids[i]), int(ids[p]), r + 1, int(ids[j]), int(scores[p]), int(scores[j])) for r, j in enumerate(fits)}
    return found


def relabelled(ids, labels):
    return np.where(ids % 7 == 0, (labels + 1) % 10, labels)


def test_negatives_of_the_query(spark):
    for sf in (SF, "/root/testdata/sf0.1"):
        ids, rows, labels = load(spark, sf)
        want = mined(ids, np.floor(rows * 256).astype(int), relabelled(ids, labels))
        assert {tuple(r) for r in multi_index.query(spark, sf).collect()} == want


def test_negatives_of_two_rounds_in_small_blocks(spark):
    rows, labels = clustered(1200)
    ids = np.arange(len(rows))
    got = multi_index.hard_negatives(frame(spark, rows, labels), anchor_modulus=40, codewords=6, block_rows=50, first_rows=60)
    want = mined(ids, np.floor(rows.astype(float) * 256).astype(int), relabelled(ids, labels), 40)
    assert {tuple(r) for r in got.collect()} == want


def test_heap_gives_cells_by_falling_bound_and_certifies():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((10, 8)) * 100
    rows = np.floor(centres[rng.integers(0, 10, 2000)] + rng.standard_normal((2000, 8)) * 4).astype(np.int64)
    index = multi_index.MultiIndex(rows[:500].astype(float), 8)
    cell, away = index.place(rows)
    facts = [(int(c), int((cell == c).sum()), away[0][cell == c].max(), away[1][cell == c].max()) for c in np.unique(cell)]
    index.settle(facts, 100)
    visits = 0
    for anchor in rows[:50]:
        cells = list(index.by_bound(anchor))
        assert len(cells) == len(index.words[0]) * len(index.words[1])
        bounds = [m for _, m, _ in cells]
        assert bounds == sorted(bounds, reverse=True)
        scores = rows @ anchor
        for c, most, least in cells:
            inside = scores[cell == c]
            assert not len(inside) or (inside.max() <= most and inside.min() >= least)
        tenth = int(np.sort(scores)[-10])
        early = set(index.blocks(anchor, None, None, None, 300, False))
        late = set(index.blocks(anchor, None, None, tenth, 300, True))
        assert not early & late
        must = {b for c in np.unique(cell[scores >= tenth]) for b in range(index.first[int(c)][0], sum(index.first[int(c)][:2]))}
        assert must <= early | late
        visits += len(early | late)
    blocks = max(b + n for b, n, _ in index.first.values())
    assert visits < 0.7 * 50 * blocks


def test_negatives_on_awkward_rows_and_empty_table(spark):
    found = [tuple(r) for r in multi_index.hard_negatives(awkward(spark)).collect()]
    rows = [r for r in awkward(spark).dropDuplicates(["vec_id", "embedding"]).collect()
            if r.vec_id is not None and r.label is not None and r.embedding and len(r.embedding) == 64
            and all(x is not None and np.isfinite(x) for x in r.embedding)]
    ids, labels = np.array([r.vec_id for r in rows]), np.array([r.label for r in rows])
    want = mined(ids, np.floor(np.array([r.embedding for r in rows]) * 256).astype(int), relabelled(ids, labels))
    assert set(found) == want and len(found) == len(want)
    assert multi_index.hard_negatives(awkward(spark).limit(0)).collect() == []
