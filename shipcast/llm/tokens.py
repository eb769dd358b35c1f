"""Encoding documents with a ``tokenizers`` vocabulary file, slice by slice.

Both vocabularies cut a text before merging: a pre-token is white space, or one
run of letters, of digits or of marks with at most one blank before it.  A text
therefore encodes as the concatenation of its chunks (a non-white run with the
white run before it, cut again between ASCII letters and marks), and each
distinct chunk of a slice is given to the library once.  Texts where that law
may not hold, those with white space outside ASCII or with "<|" (special
strings), go to the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import ragged

# White space and separators outside ASCII's six, as code points.
_EXOTIC = re.compile("[" + "".join(map(chr, [
    *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060,
    0x3000, 0xFEFF])) + "]")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
# lead bytes of the characters above
_LEAD = np.zeros(256, dtype=bool)
_LEAD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True

# the byte-level alphabet: printable Latin-1 characters stand for their own byte, others for 256 and on
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


class Encoder:
    """Ids of whole texts as the library gives them (add_special_tokens=False)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.folds = '"Lowercase"' in self.tokenizer.to_str()[:5000]
        self.memo = ragged.Memo(self._chunks)

    def _chunks(self, values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks.  A run of Latin-1 letters, with one blank before it or
        none, is one pre-token: the library's model takes it as it is, without the
        stages before the merges.  Other chunks go through all of them."""
        texts = [v.decode() for v in values]
        out: list = [None] * len(texts)
        rest = []
        for i, t in enumerate(texts):
            word = t[1:] if t[:1] == " " else t
            if word.isalpha() and max(word) <= "\xff":
                if self.folds:
                    t = word.lower()
                out[i] = [k.id for k in self.tokenizer.model.tokenize(t.encode().decode("latin-1").translate(_BYTE_CHARS))]
            else:
                rest.append(i)
        if rest:
            encoded = self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)
            for i, e in zip(rest, encoded):
                out[i] = e.ids
        return ragged.flat(out)

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row offsets, ids) of a slice of texts; null is the empty text."""
        text = ragged.text_of(column)
        odd = self._odd_rows(text) | set(np.flatnonzero(
            pc.match_substring(pc.fill_null(column, ""), "<|").to_numpy(zero_copy_only=False)).tolist())
        # a lower-casing vocabulary sees the same chunks after ASCII folding: fewer distinct ones
        folded = ragged.Text(text.offsets, _FOLD[text.data]) if self.folds else text
        bounds, ids = self.memo.gather(ragged.chunks(folded, ragged.WHITESPACE, at_marks=True))
        if not odd:
            return bounds, ids
        parts, lengths = [], np.zeros(len(text), dtype=np.int64)
        for i in range(len(text)):
            if i in odd:
                own = np.array(self.tokenizer.encode(text.row(i).decode(), add_special_tokens=False).ids, dtype=np.int32)
            else:
                own = ids[bounds[i]:bounds[i + 1]]
            parts.append(own)
            lengths[i] = len(own)
        return np.concatenate([[0], np.cumsum(lengths)]), np.concatenate(parts)

    @staticmethod
    def _odd_rows(text: ragged.Text) -> set[int]:
        at = np.flatnonzero(_LEAD[text.data])
        rows = np.unique(np.searchsorted(text.offsets, at, side="right") - 1)
        return {int(i) for i in rows if _EXOTIC.search(text.row(i).decode())}


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, loaded once per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def with_end(bounds: np.ndarray, ids: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to every row of a ragged id array."""
    n = len(bounds) - 1
    out = np.full(len(ids) + n, end_id, dtype=np.int32)
    shifted = bounds + np.arange(n + 1)
    keep = np.ones(len(out), dtype=bool)
    keep[shifted[1:] - 1] = False
    out[keep] = ids
    return shifted, out
