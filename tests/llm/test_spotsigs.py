import hashlib

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shipcast.llm import common, spotsigs

from . import helpers


def test_signatures_follow_anchors():
    assert spotsigs.signatures(b"The cat, on a MAT of straw!") == {(b"the", b"cat", b"mat"), (b"on", b"mat", b"straw"),
                                                                  (b"a", b"mat", b"straw")}
    assert spotsigs.signatures(b"one two three four") == {(b"one", b"two", b"three"), (b"two", b"three", b"four")}
    assert spotsigs.signatures(b"one two") == {(b"one", b"two")}
    assert spotsigs.signatures(b"***") == {(b"***",)} and spotsigs.signatures(b"") == set()


SETS = st.sets(st.integers(0, 12))


@given(SETS, SETS, st.floats(0.01, 1))
def test_pruned_likeness_is_exact_above_the_bound(a, b, least):
    whole = len(a & b) / len(a | b) if a | b else 1.0
    assert spotsigs.likeness(a, b) == whole
    pruned = spotsigs.likeness(a, b, least)
    assert pruned == whole if whole >= least + 1e-9 else pruned in (0.0, whole)


def _expected(rows):
    """Brute force of the query over rows in their order."""
    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 3
        edited = text[:len(text) - k] + after[:k]
        own, cut, following = (spotsigs.signatures(t.encode()) for t in (text, edited, after))

        def jaccard(a, b):
            return len(a & b) / len(a | b) if a | b else 1.0

        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), spotsigs.fingerprint(own),
                    spotsigs.fingerprint(cut), jaccard(own, cut), jaccard(own, following)))
    return out


def test_query_matches_brute_force_in_many_ranges(spark):
    docs = common.documents(spark, "/root/testdata/sf0.001")
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    for part_bytes in (30000, 1 << 30):
        got = sorted((tuple(r) for r in spotsigs.likeness_to_edits(docs, part_bytes).collect()), reverse=True)
        assert got == _expected(rows)


def test_awkward_rows_and_empty_table(spark):
    rows = spotsigs.likeness_to_edits(helpers.awkward(spark), 50000).collect()
    assert len(rows) == len(helpers.AWKWARD)
    for doc_id, text, *_ in helpers.AWKWARD:
        mine = [r for r in rows if r.doc_id == doc_id and r.n_chars == len(text or "")]
        want = spotsigs.fingerprint(spotsigs.signatures((text or "").encode()))
        assert any(r.fingerprint == want and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in mine)
    assert spotsigs.likeness_to_edits(helpers.empty(spark)).count() == 0
    one = spark.createDataFrame([(4, "the sun and the moon rise")], "doc_id long, text string")
    assert [tuple(r) for r in spotsigs.likeness_to_edits(one).collect()] == _expected([(4, "the sun and the moon rise")])


def test_similar_documents_match_all_pairs(spark):
    docs, texts = helpers.documents(spark, 150)
    found = {r.doc_id: r.component_id for r in spotsigs.similar_documents(docs, 0.8).collect()}
    sets = {i: spotsigs.signatures(t.encode()) for i, t in texts.items()}
    label = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for i in texts:
            for j in texts:
                if label[i] != label[j] and spotsigs.likeness(sets[i], sets[j]) >= 0.8:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    assert found == label
    assert spotsigs.similar_documents(helpers.empty(spark)).count() == 0
    assert spotsigs.similar_documents(helpers.awkward(spark)).count() == len(helpers.AWKWARD)


def test_large_groups_are_compared_in_tiles(spark):
    met = spark.createDataFrame([(1, i, 10, 300) for i in range(300)] + [(2, i, 10 + i, 5) for i in range(5)],
                                "key long, node long, n long, m long")
    left, right = spotsigs._tiles(met, 50)
    assert all(side.groupBy("key", "i", "j").count().agg(F.max("count")).first()[0] <= 100 for side in (left, right))
    found = {(r.u, r.v) for r in spotsigs._candidates(met, 0.8, 50).collect()}
    assert found == {(u, v) for u in range(300) for v in range(u + 1, 300)}


def test_pairs_are_checked_with_the_pruned_likeness(spark):
    rows = [(1, 2, list(range(10)), list(range(9))), (3, 4, list(range(10)), list(range(7))), (5, 6, [1, 2, 3], [1, 2, 9])]
    pairs = spark.createDataFrame(rows, "u long, v long, a array<bigint>, b array<bigint>")
    assert [tuple(r) for r in pairs.mapInArrow(spotsigs._alike(0.8), "u long, v long").collect()] == [(1, 2)]
