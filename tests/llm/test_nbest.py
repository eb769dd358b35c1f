import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from shipcast.llm import common, nbest

from . import helpers

MODEL = common.tokenizer_path("piece_bpe_32k.model")


def _all(lattice, text):
    """Every segmentation of a short text: {ids: score}."""
    text = (" " + text).replace(" ", nbest.MARK) if text else ""
    out = {}

    def go(i, score, ids):
        if i == len(text):
            out[tuple(ids)] = score
            return
        alone = False
        for j in range(i + 1, min(len(text), i + lattice.longest) + 1):
            p = lattice.pieces.get(text[i:j])
            if p is not None:
                alone |= j == i + 1
                go(j, score + int(lattice.scores[p]), [*ids, p])
        if not alone:
            go(i + 1, score + lattice.unknown, ids + lattice.byte_ids[list(text[i].encode())].tolist())

    go(0, 0, [])
    return out


@pytest.mark.parametrize("n", [1, 2, 5])
def test_n_best_match_enumeration(n):
    rng = random.Random(n)
    texts = ["", None, " ", "a", "the end", "\n", "  the", "▁x", "日\x00"]
    texts += ["".join(rng.choice(["a", "th", "e", " ", "in", "\n", "é", "☃", "t"]) for _ in range(rng.randint(1, 7)))
              for _ in range(80)]
    segment = nbest.Segmenter(MODEL, n)
    found = {}
    for i, rank, score, ids in segment.segment(pa.array(texts, type=pa.string())):
        found.setdefault(i, []).append((rank, score, tuple(ids.tolist())))
    for i, text in enumerate(texts):
        text = (text or "").replace("▁", " ")
        every = _all(segment.lattice, text)
        best = sorted(every.values(), reverse=True)[:n]
        assert [s for _, s, _ in found[i]] == best and [r for r, _, _ in found[i]] == list(range(1, len(best) + 1))
        assert len({ids for *_, ids in found[i]}) == len(best)
        for _, score, ids in found[i]:
            assert every[ids] == score and segment.lattice.decode(np.array(ids, dtype=int)) == text.encode()


def test_long_words_agree_with_arrays(monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    lattice = nbest.Lattice(MODEL)
    _, _, extra = lattice.best(words)
    for word, (score, gap) in zip(words, extra.tolist()):
        two = lattice.n_best(word, 2)
        assert two[0][0] == score and (gap == two[0][0] - two[1][0] if len(two) > 1 else gap == -nbest.LOW)
    texts = pa.array([" ".join(words[i:i + 9]) for i in range(0, 200, 9)])
    whole = [(i, s) for i, _, s, _ in nbest.Segmenter(MODEL, 3).segment(texts)]
    monkeypatch.setattr(nbest, "BATCH_CHARS", 5)
    assert [(i, s) for i, _, s, _ in nbest.Segmenter(MODEL, 3).segment(texts)] == whole


def test_awkward_rows_and_empty_table(spark):
    rows = nbest.n_best_segmentations(helpers.awkward(spark), MODEL, 2, with_ids=True).collect()
    for doc_id, text, *_ in helpers.AWKWARD:
        data = (text or "").replace("▁", " ").encode()
        mine = [r for r in rows if r.doc_id == doc_id and r.decoded_crc32 == zlib.crc32(data)]
        assert mine and {r.rank for r in mine} == ({1, 2} if data else {1})
        assert all(len(r.ids) == r.n_pieces and r.decoded_bytes == len(data) for r in mine)
    assert nbest.n_best_segmentations(helpers.empty(spark), MODEL).count() == 0


def test_query_round_trip_and_order(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text.encode() for r in common.documents(spark, sf).collect()}
    rows = nbest.query(spark, sf).orderBy("doc_id", "rank").collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert all(r.decoded_crc32 == zlib.crc32(texts[r.doc_id]) for r in rows)
    for a, b in zip(rows, rows[1:]):
        assert a.doc_id != b.doc_id or (b.rank == a.rank + 1 and b.score <= a.score and b.ids_crc32 != a.ids_crc32)
