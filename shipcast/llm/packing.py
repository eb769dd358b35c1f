"""Operator 6: packing token pieces into sequences of fixed capacity.

Pieces are spread over groups of bounded size by a hash, and each group is
packed on its own: a best-fit start, then a local search that moves a piece, or
exchanges one piece for one, two for one or one for two, between underfull bins.
A step is taken when it raises the sum of squared fills, which drains the
emptiest bins into the fuller ones until they are empty.  The search ends when
the group meets a lower bound of any packing, or when no underfull bin has a step.
A group can lose at most part of one bin to being packed apart from the others.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, ragged, tokens

CAPACITY = 1024
GROUP_ITEMS = 16384


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item: largest first, each into the fullest bin that holds it."""
    bins = np.zeros(len(sizes), dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free room
    rooms, n_bins = 0, 0  # bit r of rooms: some bin has r free
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        above = rooms >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            chosen = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, chosen = capacity, n_bins
            n_bins += 1
        bins[item] = chosen
        if room > size:
            open_bins[room - size].append(chosen)
            rooms |= 1 << (room - size)
    return bins


def _pair_sums(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sums of two of the items, and one pair of places for each."""
    order = np.argsort(sizes, kind="stable")
    ranked = sizes[order]
    some = order[np.concatenate([np.ones(min(2, len(sizes)), dtype=bool), ranked[2:] != ranked[:-2]])]  # two of a size do
    a, b = np.triu_indices(len(some), k=1)
    sums, at = np.unique(sizes[some[a]] + sizes[some[b]], return_index=True)
    return sums, np.stack([some[a[at]], some[b[at]]], axis=1)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: by total size, and where items over half a bin leave no room for the others."""
    count = np.bincount(sizes, minlength=capacity + 1)[:capacity + 1]
    weight = count * np.arange(capacity + 1)
    upto, weight_upto = np.cumsum(count), np.cumsum(weight)
    half = capacity // 2
    least = np.arange(1, half + 1)  # items below this size are left out
    alone = upto[capacity] - upto[capacity - least]
    large = upto[capacity - least] - upto[half]
    room = large * capacity - (weight_upto[capacity - least] - weight_upto[half])
    small = weight_upto[half] - weight_upto[least - 1]
    needed = alone + large + np.maximum(0, -((room - small) // capacity))
    return max(-(-int(sizes.sum()) // capacity), int(needed.max(initial=0)))


class _Index:
    """For a weight and a fill x: the greatest fill up to x among the bins that hold the weight."""

    def __init__(self, capacity: int):
        self.n = np.zeros((capacity + 1, capacity + 1), dtype=np.int32)
        self.last = np.full((capacity + 1, capacity + 1), -1, dtype=np.int16 if capacity < 1 << 15 else np.int64)
        self.fills = np.arange(capacity + 1)

    def add(self, weights: np.ndarray, fill: int, by: int) -> None:
        before = self.n[weights, fill]
        self.n[weights, fill] = before + by
        changed = weights[(before == 0) | (before + by == 0)]
        if len(changed):
            self.last[changed] = np.maximum.accumulate(np.where(self.n[changed] > 0, self.fills, -1), axis=1)


class LocalSearch:
    """Moves and exchanges between underfull bins that raise the sum of squared fills.

    The emptiest bin gives: one or two of its items move to a fuller bin, or go
    there in exchange for one smaller item, or one item goes for two smaller ones.
    Of all such steps the one with the greatest gain is taken, until the bin is
    empty or has no step; then the next emptiest gives.  Shifting weight d from a
    bin filled f to one filled t gains 2 d (t - f + d), so for each d the fullest bin
    with the room is the best; an index by weight and fill finds it among all bins.
    """

    def __init__(self, sizes: np.ndarray, bins: np.ndarray, capacity: int):
        self.sizes, self.bins, self.capacity = sizes.astype(np.int64), bins.copy(), capacity
        self.fill = np.bincount(bins, weights=sizes).astype(np.int64) if len(bins) else np.zeros(0, dtype=np.int64)
        self.bound = lower_bound(self.sizes, capacity)
        under = np.flatnonzero((self.fill < capacity) & (self.fill > 0))
        self.items = {b: [] for b in under.tolist()}
        for i in np.flatnonzero(np.isin(bins, under)).tolist():
            self.items[int(bins[i])].append(i)
        self.left = int((self.fill > 0).sum())
        self.indexed = False

    def _start(self) -> None:
        self.indexed = True
        self.one, self.two = _Index(self.capacity), _Index(self.capacity)  # one item (or none: 0), two items
        self.by_fill: list[dict] = [{} for _ in range(self.capacity)]
        self.held: dict = {}
        for b in self.items:
            self._list(b)

    def _list(self, b: int) -> None:
        """Enter a bin in the index, with the weights that it can give back."""
        own = self.sizes[self.items[b]]
        self.held[b] = np.append(0, np.unique(own)), _pair_sums(own)[0]
        self._count(b, 1)
        self.by_fill[self.fill[b]][b] = None

    def _count(self, b: int, by: int) -> None:
        for index, weights in zip((self.one, self.two), self.held[b]):
            index.add(weights, int(self.fill[b]), by)

    def _unlist(self, b: int) -> None:
        self._count(b, -1)
        del self.by_fill[self.fill[b]][b], self.held[b]

    def _step(self, donor: int) -> bool:
        if not self.indexed:
            self._start()
        sizes, fill = self.sizes, int(self.fill[donor])
        own = np.array(self.items[donor])
        single, at = np.unique(sizes[own], return_index=True)
        sums, pairs = _pair_sums(sizes[own])
        gives = [[int(own[k])] for k in at] + [[int(own[a]), int(own[b])] for a, b in pairs]
        self._count(donor, -1)  # it is no target of its own
        best = (0, None)
        for index, weights in ((self.one, np.concatenate([single, sums])), (self.two, single)):
            back = np.flatnonzero(index.last[:, -1] >= 0)
            d = weights[:, None] - back[None, :]
            target = index.last[back[None, :], np.where(d > 0, self.capacity - d, 0)].astype(np.int64)
            gain = np.where((d > 0) & (target >= 0), d * (target - fill + d), 0)
            if gain.size:
                k = int(gain.argmax())
                if gain.flat[k] > best[0]:
                    best = (int(gain.flat[k]), (index, gives[k // len(back)], int(back[k % len(back)]), int(target.flat[k])))
        self._count(donor, 1)
        if best[1] is None:
            return False
        index, give, weight, t_fill = best[1]
        which = 0 if index is self.one else 1
        to = next(b for b in self.by_fill[t_fill] if b != donor and (self.held[b][which] == weight).any())
        there = np.array(self.items[to])
        if which:
            found, places = _pair_sums(sizes[there])
            back = there[places[int(np.searchsorted(found, weight))]].tolist()
        else:
            back = [int(there[sizes[there] == weight][0])] if weight else []
        for b in (donor, to):
            self._unlist(b)
        for moved, source, into in ((give, donor, to), (back, to, donor)):
            for i in moved:
                self.items[source].remove(i)
                self.items[into].append(i)
                self.bins[i] = into
                self.fill[source] -= sizes[i]
                self.fill[into] += sizes[i]
        for b in (donor, to):
            if self.fill[b] in (0, self.capacity):
                self.left -= self.fill[b] == 0
                del self.items[b]
            else:
                self._list(b)
        return True

    def run(self, max_steps: int | None = None, max_stuck: int | None = None) -> np.ndarray:
        """Drain bins until the bound is met or no underfull bin has a step.

        ``max_steps`` and ``max_stuck``, the emptiest bins to try, cut the search short where given.
        """
        steps = 0
        while self.left > self.bound and (max_steps is None or steps < max_steps):
            before, stuck = steps, set()  # stuck: contents of bins without a step since the last one
            for donor in sorted(self.items, key=lambda b: self.fill[b])[:max_stuck]:
                while donor in self.items and self.left > self.bound and (max_steps is None or steps < max_steps):
                    content = tuple(sorted(self.sizes[self.items[donor]].tolist()))
                    if content in stuck:
                        break
                    if not self._step(donor):
                        stuck.add(content)
                        break
                    steps += 1
                    stuck.clear()
                if self.left <= self.bound:
                    break
            if steps == before:
                break
        self.steps = steps
        return self.bins


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each item; bins are numbered from 0 without gaps."""
    sizes = np.asarray(sizes, dtype=np.int64)
    if not len(sizes):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    bins = LocalSearch(sizes, best_fit(sizes, capacity), capacity).run()
    _, bins = np.unique(bins, return_inverse=True)
    order = np.argsort(bins, kind="stable")
    before = np.cumsum(sizes[order]) - sizes[order]
    starts = np.flatnonzero(np.diff(bins[order], prepend=-1))
    offsets = np.empty(len(sizes), dtype=np.int64)
    offsets[order] = before - np.repeat(before[starts], np.diff(np.append(starts, len(sizes))))
    return bins, offsets


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY,
                 with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``: doc_id, piece, start, length, ids_crc32[, ids], spread.

    Documents longer than ``capacity`` are cut; the first piece takes what is
    over a multiple of ``capacity``.  Null text is empty: one piece, its end id.
    ``spread`` is a number for dealing the pieces into groups.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
              ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids + [("spread", pa.int64())]
    schema = pa.schema(fields)

    def run(batches):
        encoder = tokens.encoder(vocabulary)
        task, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                bounds, ids = tokens.with_end(*encoder.ids(part.column("text")), end_id)
                lengths = np.diff(bounds)
                n_pieces = -(-lengths // capacity)
                row = np.repeat(np.arange(len(lengths)), n_pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                over = (lengths - (n_pieces - 1) * capacity)[row]  # size of the first piece
                start = np.where(piece == 0, 0, over + (piece - 1) * capacity)
                length = np.where(piece == 0, over, capacity)
                view = memoryview(ids.astype("<u4").tobytes())
                cut = [view[4 * a:4 * b] for a, b in zip((bounds[row] + start).tolist(),
                                                         (bounds[row] + start + length).tolist())]
                spread = np.arange(done, done + len(row)) + (task << 40)
                done += len(row)
                columns = [part.column("doc_id").take(pa.array(row)).cast(pa.int64()), pa.array(piece, type=pa.int32()),
                           pa.array(start), pa.array(length), pa.array([zlib.crc32(c) for c in cut], type=pa.int64())]
                if with_ids:
                    columns.append(pa.array([bytes(c) for c in cut], type=pa.binary()))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(spread)], schema=schema)

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", spread long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kinds)


def pack_rows(rows: DataFrame, size: str, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Add sequence_id and offset to every row; ``rows`` has a column ``spread``.

    No sequence holds more than ``capacity`` of ``size`` (rows are never larger),
    and offsets in it are gapless from 0.  A row that fills a sequence has one of
    its own (numbers below 0) and is not shuffled.  Other columns go through.
    """
    whole = rows.where(F.col(size) >= capacity)
    alone = whole.withColumn("sequence_id", -1 - F.col("spread")).withColumn("offset", F.lit(0).cast("long")).drop("spread")
    rows = rows.where(F.col(size) < capacity)
    n_groups = max(1, -(-rows.count() // group_items))
    grouped = rows.withColumn("spread", F.pmod(F.xxhash64("spread"), F.lit(n_groups)))
    out = grouped.drop("spread").schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out) + ", sequence_id long, offset long"

    def run(group: pa.Table) -> pa.Table:
        bins, offsets = pack(group.column(size).to_numpy(), capacity)
        number = group.column("spread")[0].as_py()
        return (group.drop_columns(["spread"]).append_column("sequence_id", pa.array(bins + (number << 32)))
                .append_column("offset", pa.array(offsets)))

    return alone.unionByName(grouped.groupBy("spread").applyInArrow(run, kinds))


def packed_sequences(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = CAPACITY,
                     with_ids: bool = False) -> DataFrame:
    """Token pieces of documents with their place in packed sequences."""
    pieces = common.stored(token_pieces(docs, vocabulary, end_id, capacity, with_ids), "pieces")
    return pack_rows(pieces, "length", capacity)


def query(spark, sf_dir) -> DataFrame:
    """op6: pieces of at most 1024 ids of byte_bpe_50k.json, end id 2, packed."""
    return packed_sequences(common.documents(spark, sf_dir), common.tokenizer_path("byte_bpe_50k.json"))
