import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from shipcast.llm import common, simhash
from shipcast.llm.components import connected_components

from . import helpers


def _print(text, shingle=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _groups(rows, radius=2):
    """doc_id -> least doc_id of its group, by comparing all pairs."""
    prints = [_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, f"{p:016x}", least.get(root(i))) for i, ((d, _), p) in enumerate(zip(rows, prints))]


def _key(rows):
    return sorted(map(str, rows))


def test_query_matches_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in common.documents(spark, sf).collect()]
    assert _key(tuple(r) for r in simhash.query(spark, sf).collect()) == _key(_groups(rows))


def test_awkward_rows_and_empty_table(spark):
    found = simhash.near_duplicates(helpers.awkward(spark)).collect()
    got = [(r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in found]
    assert _key(got) == _key(_groups([(r[0], r[1]) for r in helpers.AWKWARD]))
    assert simhash.near_duplicates(helpers.empty(spark)).count() == 0


def _clusters(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 12, dtype=np.int64)
    values = [base]
    for _ in range(20):
        values.append(base ^ (np.int64(1) << rng.integers(0, 63, 12)) ^ (np.int64(1) << rng.integers(0, 22, 12)))
    return np.unique(np.concatenate(values))


def test_split_groups_lose_no_link(spark):
    values = _clusters(1)
    nodes = spark.createDataFrame([(int(v),) for v in values], "fp long")
    whole = dict(tuple(r) for r in connected_components(simhash.links(nodes, 2)).collect())
    split = dict(tuple(r) for r in connected_components(simhash.links(nodes, 2, group_limit=12)).collect())
    assert whole == split
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 2
    label = values.copy()
    for _ in range(len(values)):
        label = np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1)
    assert {int(v): int(x) for v, x, n in zip(values, label, near.sum(axis=1)) if n > 1} == whole


@given(st.integers(0, 10**6), st.integers(0, 3))
@settings(max_examples=20, deadline=None)
def test_linked_sets_of_a_tile(seed, radius):
    values = _clusters(seed).view(np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
    label = np.arange(len(values))
    for _ in range(len(values)):
        label = np.where(near, label[None, :], len(values)).min(axis=1)
    want = {frozenset(values[label == k].tolist()) for k in set(label.tolist()) if (label == k).sum() > 1}
    assert {frozenset(m.tolist()) for m, _ in simhash._linked(values, radius)} == want


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (7, 3), (3, 7)]
    found = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert found == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}


def test_one_row_stays_of_each_group(spark):
    docs = helpers.awkward(spark)
    kept = simhash.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    groups = {}
    for r in simhash.near_duplicates(docs).collect():
        groups.setdefault(r.group, []).append(r.doc_id)
    got = [r.doc_id for r in kept.collect()]
    want = [min((i for i in ids if i is not None), default=None) for ids in groups.values()]
    assert sorted(got, key=str) == sorted(want, key=str)
