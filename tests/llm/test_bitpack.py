import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shipcast.llm import bitpack, common

from . import helpers


@given(st.integers(1, 31), st.integers(0, 600), st.integers(0, 2**32 - 1))
@settings(max_examples=60, deadline=None)
def test_pack_round_trip_and_random_access(bits, n, seed):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, 1 << bits, n)
    data = bitpack.pack(ids, bits)
    assert len(data) == -(-n * bits // 64) * 8
    assert (bitpack.unpack(data, n, bits) == ids).all()
    if n:
        a = int(rng.integers(0, n))
        assert (bitpack.unpack(data, n - a, bits, a) == ids[a:]).all()


def test_bits_are_the_least_that_hold_the_vocabulary():
    assert [bitpack.bits_for(v) for v in (1, 2, 3, 256, 257, 49408, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_file_reads_documents_and_ranges():
    rng = np.random.default_rng(3)
    lengths = rng.integers(0, 50, 300)
    ids = rng.integers(0, 49408, lengths.sum())
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    out = io.BytesIO()
    writer = bitpack.PackedWriter(out, 16, block=64)
    for lo, hi in ((0, 100), (100, 101), (101, 300)):
        writer.add(bounds[lo:hi + 1] - bounds[lo], ids[bounds[lo]:bounds[hi]])
        assert out.tell() == writer.n_ids // 64 * 128  # full blocks are written at once
    writer.finish()
    packed = bitpack.PackedFile.of_bytes(out.getvalue())
    for i in range(300):
        assert (packed.document(i) == ids[bounds[i]:bounds[i + 1]]).all()
    assert (packed.ids(10, 1000) == ids[10:1000]).all()
    for wrong in (b"x" * 100, b""):
        with pytest.raises(ValueError):
            bitpack.PackedFile.of_bytes(wrong)
    empty = io.BytesIO()
    bitpack.PackedWriter(empty, 16).finish()
    assert bitpack.PackedFile.of_bytes(empty.getvalue()).n_docs == 0


def test_parts_grow_beyond_their_greatest_number():
    assert common.parts_for(0) == 1 and common.parts_for(5 * common.TARGET_BYTES) == 5
    assert common.parts_for(10**14) == common.MAX_PARTS


def _expected(rows, end_id=1):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(common.tokenizer_path("word_bpe_49k.json"))
    start, out = 0, []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_awkward_rows(spark):
    got = [tuple(r) for r in bitpack.packed_token_ids(
        helpers.awkward(spark), common.tokenizer_path("word_bpe_49k.json"), file_bytes=40000).collect()]
    got.sort(key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in helpers.AWKWARD), key=lambda i: (i is not None, i))
    texts = {r[0]: r[1] for r in helpers.AWKWARD if r[0] is not None}
    nulls = {(n, crc) for _, _, n, crc in _expected([(None, r[1]) for r in helpers.AWKWARD if r[0] is None])}
    assert {r[2:] for r in got if r[0] is None} == nulls
    start = 0
    for doc_id, at, n, crc in got:
        assert at == start
        start += n
        if doc_id is not None:
            assert (n, crc) == _expected([(doc_id, texts[doc_id])])[0][2:]


def test_empty_table(spark):
    assert bitpack.packed_token_ids(helpers.empty(spark), common.tokenizer_path("word_bpe_49k.json")).count() == 0


def test_query_matches_the_library(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in common.documents(spark, sf).collect())
    assert sorted(tuple(r) for r in bitpack.query(spark, sf).collect()) == _expected(docs)
