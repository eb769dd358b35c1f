import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shipcast.llm import common, ragged, tokens

ALPHABET = ["a", "B", "ß", "µ", "ª", "ÿ", "Þ", "æ", "Œ", "ŉ", "don", "the", " ", "  ", "\n", "\t", "'s", "'", ",", "!!", "_", "1", "22", "é", "É", "é", " ",
            "　", "·", "×", "İ", "日", "<|endoftext|>", "<|EndOfText|>", "\x1c", "«", "ﬁ"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=25).map("".join), min_size=1, max_size=8))
@settings(max_examples=150, deadline=None)
def test_ids_equal_the_library(name, texts):
    encoder = tokens.encoder(common.tokenizer_path(name))
    bounds, ids = encoder.ids(pa.array(texts, type=pa.string()))
    for i, text in enumerate(texts):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n_extra", [0, 1])
def test_memo_forgets_without_changing_results(n_extra):
    encoded = []

    def encode(values):
        encoded.extend(values)
        found = ragged.flat([[len(v), v[0]] * (len(v) % 2) for v in values])
        return (*found, np.array([[len(v)] for v in values])) if n_extra else found

    memo = ragged.Memo(encode, limit=12, n_extra=n_extra)
    rng = np.random.default_rng(0)
    common_words = [b"a", b"bb", b"ccc"]
    for turn in range(40):
        words = [*common_words, *(f"w{turn}x{i}".encode() for i in range(rng.integers(0, 9)))]
        words = [words[i] for i in rng.integers(0, len(words), 30)] + common_words
        pieces = ragged.words(ragged.text_of(pa.array([b" ".join(words).decode()])))
        rows = memo.rows(pieces.values.to_pylist())
        bounds, ids = memo.gather(pieces, rows)
        assert ids.tolist() == [x for w in words for x in (len(w), w[0]) if len(w) % 2]
        assert bounds.tolist() == [0, len(ids)] and len(memo.known) <= 24
        if n_extra:
            assert memo.extra[rows, 0].tolist() == [len(v) for v in pieces.values.to_pylist()]
    assert encoded.count(b"bb") < 10  # words of many slices are kept


def test_words_and_chunks_of_rows():
    column = pa.array(["a b", None, "", "  ", "b a\n", "c"]).slice(0, 6)
    text = ragged.text_of(column)
    found = ragged.words(text)
    values = found.values.to_pylist()
    rows = [[values[c] for c in found.codes[found.bounds[i]:found.bounds[i + 1]]] for i in range(6)]
    assert rows == [[b"a", b"b"], [], [], [], [b"b", b"a"], [b"c"]]
    cut = ragged.chunks(text, ragged.WHITESPACE)
    values = cut.values.to_pylist()
    assert [[values[c] for c in cut.codes[cut.bounds[i]:cut.bounds[i + 1]]] for i in range(6)] == [
        [b"a", b" b"], [], [], [b"  "], [b"b", b" a", b"\n"], [b"c"]]


def test_end_ids_follow_every_row():
    bounds, ids = tokens.with_end(np.array([0, 2, 2, 3]), np.array([5, 6, 7]), 9)
    assert bounds.tolist() == [0, 3, 4, 6] and ids.tolist() == [5, 6, 9, 9, 7, 9]
