import random

import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from shipcast.llm import common, token_counts

from . import helpers

MODEL = common.tokenizer_path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
PARTS = ["a", "b", "th", "er", "the", " ", "   ", "\n", "\t", "é", "ß", "1", ".", ",", "=", "日", "☃", "▁",
         "<s>", "</s>", "<0x41>", "\x00", "aa"]


@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=40).map("".join), min_size=1, max_size=10))
@settings(max_examples=150, deadline=None)
def test_counts_equal_the_library(texts):
    counts = token_counts.counter(MODEL).counts(pa.array(texts, type=pa.string()))
    assert counts.tolist() == [len(LIBRARY.encode(t)) for t in texts]


def test_long_runs_and_long_words():
    rng = random.Random(4)
    texts = [" " * n + end for n in range(0, 90, 7) for end in ("", "the", "\n")]
    texts += ["".join(rng.choice("aeinrst") for _ in range(3000)), "ab" * 4000, "x" * 4001, " " * 5000 + "end"]
    counts = token_counts.counter(MODEL).counts(pa.array(texts))
    assert counts.tolist() == [len(LIBRARY.encode(t)) for t in texts]


def test_awkward_rows_and_empty_table(spark):
    got = sorted(map(str, token_counts.token_counts(helpers.awkward(spark), MODEL, limit=10).collect()))
    want = []
    for doc_id, text, *_ in helpers.AWKWARD:
        n = len(LIBRARY.encode(text or ""))
        want.append(f"Row(doc_id={doc_id}, n_bytes={len((text or '').encode())}, n_tokens={n}, over_limit={n > 10})")
    assert got == sorted(want)
    assert token_counts.token_counts(helpers.empty(spark), MODEL).count() == 0


def test_query_matches_the_library(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in common.documents(spark, sf).collect()}
    for r in token_counts.query(spark, sf).collect():
        n = len(LIBRARY.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)
