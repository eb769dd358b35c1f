"""Vectorised text helpers used inside Spark tasks.

A task sees its documents as Arrow batches.  The helpers here view a string
column as one byte array with row offsets, cut it into words or pre-tokens with
a few numpy passes, and reduce the cut to distinct strings with Arrow's
dictionary encoding, so per-string Python work is done once per distinct string
of a slice and not once per occurrence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The ASCII white space of the word pattern [^\x20\x09-\x0D]+.
WHITESPACE = np.zeros(256, dtype=bool)
WHITESPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
SPACE = np.zeros(256, dtype=bool)
SPACE[0x20] = True
# ASCII letters, and ASCII marks other than the apostrophe (which opens contractions).
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
MARK = np.zeros(256, dtype=bool)
MARK[[i for i in range(0x21, 0x7F) if not chr(i).isalnum() and i != 0x27]] = True

SLICE_BYTES = 6 << 20


@dataclass
class Text:
    """A string column as bytes: row i is data[offsets[i]:offsets[i + 1]]."""

    offsets: np.ndarray
    data: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def row(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


def text_of(column: pa.Array | pa.ChunkedArray) -> Text:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return Text(np.zeros(n + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8))
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + n + 1]
    return Text(at - at[0], np.frombuffer(data, dtype=np.uint8)[at[0]:at[-1]])


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch whose text stays near ``max_bytes`` (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


@dataclass
class Pieces:
    """Sub-strings of a slice as indices into its distinct strings.

    Row i owns ``codes[bounds[i]:bounds[i + 1]]``; ``values[codes[j]]`` is the
    j-th sub-string, as bytes.
    """

    codes: np.ndarray
    bounds: np.ndarray
    values: pa.Array


def _distinct(data: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, pa.Array]:
    """Dictionary codes of the contiguous strings beginning at ``starts``."""
    if len(starts) == 0:
        return np.zeros(0, dtype=np.int64), pa.array([], type=pa.large_binary())
    offsets = np.append(starts, end).astype(np.int64)
    strings = pa.Array.from_buffers(pa.large_binary(), len(starts),
                                    [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    coded = strings.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def words(text: Text) -> Pieces:
    """Maximal runs of non-white-space of every row."""
    inside = ~WHITESPACE[text.data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = text.offsets[:-1][text.offsets[:-1] < len(inside)]
    first[heads] = inside[heads]  # a row's first byte starts a word of its own, its last one ends one
    tails = heads[heads > 0] - 1
    last[tails] = inside[tails]
    starts, lengths = np.flatnonzero(first), np.flatnonzero(last)
    lengths -= starts - 1
    codes, values = _distinct(text.data[inside], np.cumsum(lengths) - lengths, int(lengths.sum()))
    return Pieces(codes, np.searchsorted(starts, text.offsets), values)


def chunks(text: Text, blank: np.ndarray, at_marks: bool = False) -> Pieces:
    """Pre-tokens: each run of non-blank bytes with the blank run before it.

    A blank run at the end of a row is a chunk of its own.  ``at_marks`` also
    cuts between an ASCII letter and an ASCII mark.  The chunks of a row are
    contiguous and cover it.
    """
    gap = blank[text.data]
    first = gap.copy()
    first[1:] &= ~gap[:-1]
    if at_marks:
        letter, mark = LETTER[text.data], MARK[text.data]
        first[1:] |= (letter[1:] & mark[:-1]) | (mark[1:] & letter[:-1])
    first[text.offsets[:-1][text.offsets[:-1] < len(gap)]] = True
    starts = np.flatnonzero(first)
    codes, values = _distinct(text.data, starts, len(gap))
    return Pieces(codes, np.searchsorted(starts, text.offsets), values)


class Memo:
    """Ragged int32 results of distinct strings, computed once and kept.

    ``encode`` maps a list of distinct byte strings to the lengths and the
    concatenation of their ids (and, with ``n_extra``, as many numbers for each
    string, kept in ``extra``).  Beyond ``limit`` strings the memo keeps those
    that came in two slices or more (or starts afresh where that is over half),
    so its memory is bounded; results never depend on what it holds.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, ...]], limit: int = 700_000, n_extra: int = 0):
        self.encode, self.limit, self.n_extra = encode, limit, n_extra
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int64)
        self.uses = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)
        self.extra = np.zeros((0, self.n_extra), dtype=np.int64)

    def _shrink(self) -> None:
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > self.limit // 2:
            self._clear()
            return
        names, starts, lengths = list(self.known), self.starts[keep], self.lengths[keep]
        self.known = {names[k]: i for i, k in enumerate(keep.tolist())}  # known is in row order
        ends = np.cumsum(lengths)
        self.ids = self.ids[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        self.extra = self.extra[keep] if self.n_extra else self.extra
        self.starts, self.lengths, self.uses = ends - lengths, lengths, np.ones(len(keep), dtype=np.int64)

    def rows(self, values: list[bytes]) -> np.ndarray:
        """Row numbers of the strings, encoding those not seen yet."""
        if len(self.known) + len(values) > self.limit:
            self._shrink()
        known = self.known
        fresh = [v for v in values if v not in known]
        if fresh:
            lengths, ids, *extra = self.encode(fresh)
            for i, v in enumerate(fresh, len(known)):
                known[v] = i
            starts = np.cumsum(lengths) - lengths + len(self.ids)
            self.starts = np.concatenate([self.starts, starts])
            self.lengths = np.concatenate([self.lengths, lengths])
            if extra:
                self.extra = np.concatenate([self.extra, extra[0]])
            self.uses = np.concatenate([self.uses, np.zeros(len(fresh), dtype=np.int64)])
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        rows = np.fromiter((known[v] for v in values), dtype=np.int64, count=len(values))
        self.uses[rows] += 1
        return rows

    def gather(self, pieces: Pieces, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every row of a slice: (row offsets into ids, ids).  ``rows``: what rows() gave for its values."""
        rows = self.rows(pieces.values.to_pylist()) if rows is None else rows
        rows = rows[pieces.codes] if len(pieces.codes) else pieces.codes
        lengths = self.lengths[rows]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(self.starts[rows] - ends[:-1], lengths) + np.arange(ends[-1])
        return ends[pieces.bounds], self.ids[at]


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, concatenation) of id lists."""
    lengths = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    out = np.fromiter((i for ids in lists for i in ids), dtype=np.int32, count=int(lengths.sum()))
    return lengths, out
