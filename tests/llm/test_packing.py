import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from shipcast.llm import common, packing

from . import helpers


@given(st.lists(st.integers(1, 32), max_size=120))
@settings(max_examples=80, deadline=None)
def test_packing_is_valid_and_no_worse_than_best_fit(sizes):
    sizes = np.array(sizes, dtype=np.int64)
    bins, offsets = packing.pack(sizes, 32)
    if not len(sizes):
        return
    fill = np.bincount(bins, weights=sizes)
    assert fill.max() <= 32 and fill.min() > 0
    assert len(fill) <= packing.best_fit(sizes, 32).max() + 1
    for b in range(len(fill)):
        mine = np.flatnonzero(bins == b)
        mine = mine[np.argsort(offsets[mine])]
        assert (offsets[mine] == np.cumsum(sizes[mine]) - sizes[mine]).all()


def test_search_empties_bins_of_a_poor_start():
    rng = np.random.default_rng(0)
    sizes = rng.integers(20, 400, 300)
    start = np.arange(300)  # every item alone
    search = packing.LocalSearch(sizes, start, 1024)
    bins = search.run(max_steps=10000, max_stuck=400)
    fill = np.bincount(bins, weights=sizes, minlength=300)
    assert fill.max() <= 1024 and search.left == (fill > 0).sum()
    assert search.left <= 1.1 * search.bound


def test_exchange_where_no_move_fits():
    sizes = np.array([6, 3, 5, 4, 2])  # {6, 3} {5, 4} {2}: 2 fits nowhere, exchanges free its bin
    bins = packing.LocalSearch(sizes, np.array([0, 0, 1, 1, 2]), 10).run()
    assert len(set(bins.tolist())) == 2 or np.bincount(bins, weights=sizes).max() <= 10


def _gaining_step(sizes, bins, capacity):
    """Whether any step between two underfull bins raises the sum of squared fills, by trying all."""
    held = [sizes[bins == b].tolist() for b in np.unique(bins)]
    held = [(sum(h), h) for h in held if sum(h) < capacity]
    pairs = [[a + b for k, a in enumerate(h) for b in h[k + 1:]] for _, h in held]
    for i, (fill, own) in enumerate(held):
        for j, (t, there) in enumerate(held):
            if i != j:
                shifts = {w - back for w in own + pairs[i] for back in [0, *there]} | {w - back for w in own for back in pairs[j]}
                if any(0 < d <= capacity - t and t - fill + d > 0 for d in shifts):
                    return True
    return False


def test_search_ends_only_without_a_step():
    rng = np.random.default_rng(3)
    for sizes in (rng.integers(300, 500, 600), rng.choice([301, 343, 411, 517, 209], 600), rng.integers(200, 340, 400)):
        search = packing.LocalSearch(sizes, packing.best_fit(sizes, 1024), 1024)
        bins = search.run()
        fill = np.bincount(bins, weights=sizes)
        assert fill.max() <= 1024 and search.left == (fill > 0).sum() >= search.bound
        assert search.left == search.bound or not _gaining_step(sizes, bins, 1024)


@given(st.lists(st.integers(1, 12), min_size=1, max_size=9))
@settings(max_examples=60, deadline=None)
def test_bound_is_a_lower_bound(sizes):
    def fewest(rest, rooms):
        if not rest:
            return len(rooms)
        tried = {r for r in rooms if r >= rest[0]}
        best = fewest(rest[1:], [*rooms, 12 - rest[0]])
        for r in tried:
            k = rooms.index(r)
            best = min(best, fewest(rest[1:], [*rooms[:k], r - rest[0], *rooms[k + 1:]]))
        return best

    assert packing.lower_bound(np.array(sizes), 12) <= fewest(sorted(sizes, reverse=True), [])


def _check(rows, docs, capacity=1024, end_id=2):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(common.tokenizer_path("byte_bpe_50k.json"))
    for doc_id, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id]
        first = len(ids) % capacity or min(len(ids), capacity)
        cuts = [(0, first)] + [(a, a + capacity) for a in range(first, len(ids), capacity)]
        want = [(k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(cuts)]
        got = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == doc_id})
        assert set(want) <= set(got)
    place = {}
    for r in rows:
        place.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in place.values():
        spans.sort()
        assert [a for a, _ in spans] == np.cumsum([0] + [n for _, n in spans])[:-1].tolist()
        assert sum(n for _, n in spans) <= capacity
    return len(place)


def test_awkward_rows(spark):
    rows = packing.packed_sequences(helpers.awkward(spark), common.tokenizer_path("byte_bpe_50k.json")).collect()
    n = _check(rows, [(r[0], r[1]) for r in helpers.AWKWARD])
    total = sum(r.length for r in rows)
    assert n == -(-total // 1024)
    assert sum(1 for r in rows if r.doc_id == 5) == 2 and sum(1 for r in rows if r.doc_id is None) == 2


def test_small_groups_pack_all_rows(spark):
    docs, texts = helpers.documents(spark)
    pieces = common.stored(packing.token_pieces(docs, common.tokenizer_path("byte_bpe_50k.json"), 2, 64, True), "t")
    rows = packing.pack_rows(pieces, "length", 64, group_items=25).collect()
    _check(rows, texts.items(), 64)
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)


def test_empty_table(spark):
    assert packing.packed_sequences(helpers.empty(spark), common.tokenizer_path("byte_bpe_50k.json")).count() == 0
