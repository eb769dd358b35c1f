"""Operator 4: token counts by rank-synchronous merging of ragged arrays.

A merge vocabulary in sentencepiece's BPE form starts from single characters and
joins, again and again, the adjacent pair whose joined piece ranks first, the
leftmost of equals.  Pieces hold white space marks only at their start, so no
merge reaches across the start of a word: a text is cut into pre-tokens (a run of
blanks and the word after it), and each distinct pre-token is merged once.

All pre-tokens of a batch lie in one ragged array and advance together: each
round finds every sequence's lowest-rank pair and applies it, in all places at
once where no new pair could come before the remaining ones, else in the leftmost
place.  Sequences without a pair are done; their surviving symbols are counted.
A character that is no piece counts as its UTF-8 bytes (byte fallback).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, ragged

MARK = "\u2581"  # the white-space mark of pieces
NONE = np.int64(1) << 40


class MergeTable:
    """Ranks of symbol pairs, from the pieces of a sentencepiece BPE model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {model.id_to_piece(i): i for i in range(model.get_piece_size())
                  if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces span word starts; pre-tokens would not be independent")
        symbols = dict(pieces)
        for p in pieces:
            for c in p:
                symbols.setdefault(c, model.get_piece_size() + len(symbols))
        self.size = max(symbols.values()) + 1
        scores = sorted({model.get_score(i) for i in pieces.values()}, reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        pairs = {}
        for p, i in pieces.items():
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = (rank_of[model.get_score(i)], i)
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.keys = np.append(keys, np.int64(1) << 62)
        self.ranks = np.array([pairs[k][0] for k in keys.tolist()] + [0], dtype=np.int64)
        self.joined = np.array([pairs[k][1] for k in keys.tolist()] + [0], dtype=np.int64)
        # code point -> symbol; characters outside the vocabulary map to self.size + their bytes
        self.first = np.full(0x110000, self.size + 4, dtype=np.int32)
        self.first[:0x10000], self.first[:0x800], self.first[:0x80] = self.size + 3, self.size + 2, self.size + 1
        for c, i in symbols.items():
            if len(c) == 1 and c in pieces:
                self.first[ord(c)] = i
        self.first[0x20] = symbols[MARK]
        self.longest_run = max(len(p) for p in pieces if not p.strip(MARK))
        self.mark = symbols[MARK]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, joined symbol) of pairs; NONE where the pair is no piece."""
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        hit = (self.keys[at] == key) & (left < self.size) & (right < self.size)
        return np.where(hit, self.ranks[at], NONE), self.joined[at]


def merge(table: MergeTable, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Symbols left of each sequence, in bytes or pieces, after all merges."""
    counts = np.zeros(len(lengths), dtype=np.int64)
    weights = np.ones(table.size + 5, dtype=np.int64)
    weights[table.size:] = np.arange(5)
    seq = np.repeat(np.arange(len(lengths)), lengths)
    sym = symbols.astype(np.int64)
    while len(sym):
        follows = np.zeros(len(sym), dtype=bool)
        follows[:-1] = seq[1:] == seq[:-1]
        rank = np.full(len(sym), NONE)
        joined = np.zeros(len(sym), dtype=np.int64)
        at = np.flatnonzero(follows)
        rank[at], joined[at] = table.look_up(sym[at], sym[at + 1])
        heads = np.flatnonzero(np.diff(seq, prepend=-1))
        sizes = np.diff(np.append(heads, len(seq)))
        least = np.minimum.reduceat(rank, heads)
        live = np.repeat(least < NONE, sizes)
        if not live.all():  # finished sequences leave the arrays
            np.add.at(counts, seq[~live], weights[sym[~live]])
            sym, seq, rank, joined = sym[live], seq[live], rank[live], joined[live]
            if not len(sym):
                break
            heads = np.flatnonzero(np.diff(seq, prepend=-1))
            sizes = np.diff(np.append(heads, len(seq)))
            least = least[least < NONE]
        low = np.repeat(least, sizes)
        chosen = rank == low
        # of overlapping places (x x x) take every second one, from the left
        run = np.flatnonzero(chosen)
        broken = np.diff(run, prepend=-2) != 1
        begin = np.maximum.accumulate(np.where(broken, np.arange(len(run)), 0))
        chosen[run[(np.arange(len(run)) - begin) % 2 == 1]] = False
        many = np.add.reduceat(chosen.astype(np.int64), heads) > 1
        if many.any():
            chosen &= ~_unsafe(table, sym, seq, joined, chosen, low, heads, many)
        place = np.flatnonzero(chosen)
        sym[place] = joined[place]
        keep = np.ones(len(sym), dtype=bool)
        keep[place + 1] = False
        sym, seq = sym[keep], seq[keep]
    return counts


def _unsafe(table, sym, seq, joined, chosen, low, heads, many) -> np.ndarray:
    """Places to put off: all but the leftmost, in sequences where a merge could
    make a pair that comes before the places still waiting."""
    place = np.flatnonzero(chosen)
    own = joined[place]
    early = np.zeros(len(place), dtype=bool)

    def test(left, right, valid):
        rank, _ = table.look_up(left, right)
        early[:] |= valid & (rank <= low[place])

    n = len(sym)
    before, after = np.maximum(place - 1, 0), np.minimum(place + 2, n - 1)
    has_before = (place > 0) & (seq[before] == seq[place])
    has_after = (place + 2 < n) & (seq[after] == seq[place])
    test(sym[before], own, has_before)
    test(own, sym[after], has_after)
    # neighbours that were merged in the same round
    joined_before = has_before & (place > 1) & chosen[np.maximum(place - 2, 0)]
    test(joined[np.maximum(place - 2, 0)], own, joined_before)
    test(own, joined[after], has_after & chosen[after])
    risky = np.zeros(len(heads), dtype=bool)
    which = np.searchsorted(heads, place, side="right") - 1
    risky[which[early]] = True
    risky &= many
    leftmost = np.zeros(n, dtype=bool)
    leftmost[place[np.diff(which, prepend=-1) != 0]] = True
    out = np.zeros(n, dtype=bool)
    out[place] = risky[which]
    return out & ~leftmost


class Counter:
    """Token counts of whole texts."""

    def __init__(self, path: str):
        self.table = MergeTable(path)
        self.memo = ragged.Memo(self._count)

    def _count(self, values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts, spare = [], np.zeros(len(values), dtype=np.int64)
        run = self.table.longest_run
        for i, v in enumerate(values):
            blanks = len(v) - len(v.lstrip(b" "))
            if blanks > 3 * run:
                # blanks join last and from the left: whole longest runs come off the front first
                spare[i] = blanks // run - 2
                v = v[spare[i] * run:]
            texts.append(v.decode())
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        counts = merge(self.table, self.table.first[points], lengths) + spare
        return np.ones(len(values), dtype=np.int64), counts.astype(np.int32)

    def counts(self, column: pa.Array) -> np.ndarray:
        """Tokens of every text of a slice; null and empty texts have none."""
        column = pc.fill_null(column, "").cast(pa.large_string())
        column = pc.replace_substring(column, MARK, " ")  # a mark in a text is a blank
        blank, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
        marked = pc.if_else(pc.equal(pc.binary_length(column), 0), column,
                            pc.binary_join_element_wise(blank, column, none))
        bounds, ids = self.memo.gather(ragged.chunks(ragged.text_of(marked), ragged.SPACE))
        totals = np.concatenate([[0], np.cumsum(ids, dtype=np.int64)])
        return totals[bounds[1:]] - totals[bounds[:-1]]


_LOADED: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _LOADED:
        _LOADED[path] = Counter(path)
    return _LOADED[path]


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of ``docs(doc_id, text)``; one row per row.

    Null text counts as empty: no bytes, no tokens.  Other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()),
                        ("over_limit", pa.bool_())])

    def run(batches):
        count = counter(model)
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                n = count.counts(part.column("text"))
                sizes = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), sizes, pa.array(n), pa.array(n > limit)], schema=schema)

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"))


def query(spark, sf_dir) -> DataFrame:
    """op4: counts of piece_bpe_32k.model."""
    return token_counts(common.documents(spark, sf_dir), common.tokenizer_path("piece_bpe_32k.model"))
