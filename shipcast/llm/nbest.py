"""Operator 9: N-best segmentation over a piece lattice, and decoding.

A text's lattice has a node between characters and an edge for every vocabulary
piece that fits; a segmentation's score is the sum of its pieces' scores in the
model file.  No piece holds a white-space mark after another character, so the
lattice falls apart into one for each pre-token (a run of blanks and the word
after it), and the text's N best segmentations are the N best sums of choices.

* Forward: Viterbi scores of all distinct pre-tokens of a slice at once, over one
  ragged array of edges; with the backward scores they also give each
  pre-token's gap, the loss of its second best segmentation.
* Only the N - 1 occurrences of least gap can differ from their best in the N
  best of a text (each of them alone loses no more than any other would).
* Backward: for those, A-star from the end of the pre-token, with the forward
  scores as exact estimates, takes segmentations off the heap in order.

Characters outside the vocabulary are edges of their own, at a penalty below all
pieces, and are written as byte pieces.  Decoding joins the pieces' bytes, turns
marks into blanks and takes off the first one, which encoding puts there.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, ragged

MARK = "\u2581"
LOW = np.int64(-1) << 60
BATCH_CHARS = 64  # pre-tokens up to this length go through the arrays


class Lattice:
    """Pieces, their scores and a character trie of a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [i for i in range(model.get_piece_size())
                  if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.pieces = {model.id_to_piece(i): i for i in usable}
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("pieces span word starts; pre-tokens would not be independent")
        self.size = model.get_piece_size()
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        self.scores = np.zeros(self.size, dtype=np.int64)
        for i in usable:
            self.scores[i] = round(model.get_score(i))  # BPE scores are whole numbers: sums are exact
        ordinary = self.scores[usable]
        self.unknown = int(ordinary[ordinary > -10**8].min()) - 10
        self.longest = max(map(len, self.pieces))
        nodes, moves, accept = {"": 0}, {}, [-1]
        for p, i in self.pieces.items():
            for k in range(1, len(p) + 1):
                if p[:k] not in nodes:
                    nodes[p[:k]] = len(nodes)
                    accept.append(-1)
                    moves[(nodes[p[:k - 1]] << 21) + ord(p[k - 1])] = nodes[p[:k]]
            accept[nodes[p]] = i
        self.keys = np.array(sorted(moves), dtype=np.int64)
        self.next = np.array([moves[k] for k in self.keys.tolist()], dtype=np.int64)
        self.accept = np.array(accept, dtype=np.int64)
        # bytes of every id, for decoding
        texts = [b""] * self.size
        for p, i in self.pieces.items():
            texts[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_ids.tolist()):
            texts[i] = bytes([b])
        self.text_lengths = np.array(list(map(len, texts)), dtype=np.int64)
        self.text_starts = np.cumsum(self.text_lengths) - self.text_lengths
        self.text_bytes = np.frombuffer(b"".join(texts), dtype=np.uint8)

    # --- forward, in arrays -----------------------------------------------------

    def _edges(self, chars: np.ndarray, stops: np.ndarray):
        """(first character, length, piece) of all edges; an unknown character's piece is -1."""
        at, node = np.arange(len(chars)), np.zeros(len(chars), dtype=np.int64)
        alone = np.zeros(len(chars), dtype=bool)
        found = []
        for length in range(1, self.longest + 1):
            inside = at + length <= stops[at]
            at, node = at[inside], node[inside]
            if not len(at):
                break
            key = (node << 21) + chars[at + length - 1]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[place] == key
            at, node = at[hit], self.next[place[hit]]
            piece = self.accept[node]
            ends = piece >= 0
            if length == 1:
                alone[at[ends]] = True
            found.append((at[ends], np.full(int(ends.sum()), length), piece[ends]))
        missing = np.flatnonzero(~alone)
        found.append((missing, np.ones(len(missing), dtype=np.int64), np.full(len(missing), -1)))
        return tuple(np.concatenate(c) for c in zip(*found))

    def best(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lengths, ids, [score, gap]) of the best segmentations of short words.

        The gap is the loss of the second best, or -LOW where there is only one.
        """
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        chars[chars == 0x20] = ord(MARK)
        starts = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(words)), sizes)
        first, length, piece = self._edges(chars, np.repeat(starts + sizes, sizes))
        source = first + word[first]  # lattice node: each word has one more than it has characters
        target = source + length
        weight = np.where(piece >= 0, self.scores[np.maximum(piece, 0)], self.unknown)
        offset = first - starts[word[first]]
        n_nodes = len(chars) + len(words)
        forward, via = np.full(n_nodes, LOW), np.full(n_nodes, -1)
        begin, end = starts + np.arange(len(words)), starts + np.arange(len(words)) + sizes
        forward[begin] = 0
        by_offset = np.argsort(offset, kind="stable")
        cuts = np.searchsorted(offset[by_offset], np.arange(sizes.max(initial=0) + 1))
        for r in range(len(cuts) - 1):  # edges that start r characters into their word
            e = by_offset[cuts[r]:cuts[r + 1]]
            value = forward[source[e]] + weight[e]
            better = value > forward[target[e]]
            forward[target[e[better]]], via[target[e[better]]] = value[better], e[better]
        backward = np.full(n_nodes, LOW)
        backward[end] = 0
        stop = offset + length
        by_stop = np.argsort(stop, kind="stable")
        cuts = np.searchsorted(stop[by_stop], np.arange(sizes.max(initial=0) + 2))
        for r in range(len(cuts) - 2, 0, -1):
            e = by_stop[cuts[r]:cuts[r + 1]]
            value = np.where(backward[target[e]] > LOW, backward[target[e]] + weight[e], LOW)
            better = value > backward[source[e]]
            backward[source[e[better]]] = value[better]
        # walk the best paths from their ends
        on_best = np.zeros(len(first), dtype=bool)
        steps, here, live = [], end.copy(), np.flatnonzero(sizes > 0)
        while len(live):
            e = via[here[live]]
            on_best[e] = True
            steps.append((live, e))
            here[live] = source[e]
            live = live[here[live] > begin[live]]
        score = forward[end]
        through = forward[source] + weight + backward[target]
        possible = ~on_best & (backward[target] > LOW) & (forward[source] > LOW)
        second = np.full(len(words), LOW)
        np.maximum.at(second, word[first[possible]], through[possible])
        gap = np.where(second > LOW, score - second, -LOW)
        if steps:
            owner, edge = (np.concatenate(c) for c in zip(*steps))
            turn = np.concatenate([np.full(len(w), i) for i, (w, _) in enumerate(steps)])
            order = np.lexsort((-turn, owner))
            owner, edge = owner[order], edge[order]
        else:
            owner = edge = np.zeros(0, dtype=np.int64)
        lengths, ids = self._written(owner, piece[edge], chars[first[edge]], len(words))
        return lengths, ids, np.stack([score, gap], axis=1)

    def _written(self, owner, piece, char, n) -> tuple[np.ndarray, np.ndarray]:
        """Ids by owner; unknown characters become the ids of their bytes."""
        sizes = np.ones(len(piece), dtype=np.int64)
        unknown = np.flatnonzero(piece < 0)
        spelt = [chr(c).encode() for c in char[unknown].tolist()]
        sizes[unknown] = list(map(len, spelt))
        ids = np.repeat(piece, sizes).astype(np.int32)
        if len(unknown):
            ids[ids < 0] = self.byte_ids[np.frombuffer(b"".join(spelt), dtype=np.uint8)]
        return np.bincount(owner, weights=sizes, minlength=n).astype(np.int64), ids

    # --- backward search -----------------------------------------------------------

    def n_best(self, word: str, n: int) -> list[tuple[int, list[int]]]:
        """The n best (score, ids) of a word, best first; of equal scores, those with longer last pieces first."""
        word = word.replace(" ", MARK)
        into: list[list[tuple[int, int, int]]] = [[] for _ in range(len(word) + 1)]  # (start, piece, score) by end
        forward = [0] + [int(LOW)] * len(word)
        for i in range(len(word)):
            alone = False
            for j in range(i + 1, min(i + self.longest, len(word)) + 1):
                p = self.pieces.get(word[i:j])
                if p is not None:
                    alone |= j == i + 1
                    s = int(self.scores[p])
                    into[j].append((i, p, s))
                    forward[j] = max(forward[j], forward[i] + s)
            if not alone:
                into[i + 1].append((i, -1, self.unknown))
                forward[i + 1] = max(forward[i + 1], forward[i] + self.unknown)
        # (-estimate, node, turn, score after the node, path): of equal estimates the one
        # nearest to the start goes on, else ties would spread over all their paths
        heap = [(-forward[-1], len(word), 0, 0, None)]
        found, turn = [], 0
        while heap and len(found) < n:
            estimate, node, _, after, path = heapq.heappop(heap)
            if node == 0:
                ids = []
                while path:
                    i, p, path = path
                    ids.extend([p] if p >= 0 else self.byte_ids[list(word[i].encode())].tolist())
                found.append((-estimate, ids))
                continue
            for i, p, s in into[node]:
                turn += 1
                heapq.heappush(heap, (-(forward[i] + s + after), i, turn, s + after, (i, p, path)))
        return found

    # --- decoding --------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of a text's ids, without the blank that encoding puts in front."""
        lengths = self.text_lengths[ids]
        ends = np.cumsum(lengths)
        at = np.repeat(self.text_starts[ids] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        return self.text_bytes[at].tobytes()[1:]


class Segmenter:
    """N best segmentations of whole texts."""

    def __init__(self, path: str, n: int):
        self.lattice, self.n = Lattice(path), n
        self.memo = ragged.Memo(self._best, limit=500_000, n_extra=2)
        self.searched: dict[bytes, list[tuple[int, np.ndarray]]] = {}

    def _best(self, values: list[bytes]):
        texts = [v.decode() for v in values]
        short = [i for i, t in enumerate(texts) if len(t) <= BATCH_CHARS]
        if len(short) == len(texts):
            return self.lattice.best(texts)
        lengths, ids, extra = self.lattice.best([texts[i] for i in short])
        ends = np.cumsum(lengths)
        parts: list = [None] * len(texts)
        found = np.zeros((len(texts), 2), dtype=np.int64)
        for k, i in enumerate(short):
            parts[i], found[i] = ids[ends[k] - lengths[k]:ends[k]], extra[k]
        for i in set(range(len(texts))) - set(short):  # long ones are searched on their own
            two = self.lattice.n_best(texts[i], 2)
            parts[i] = np.array(two[0][1], dtype=np.int32)
            found[i] = two[0][0], (two[0][0] - two[1][0] if len(two) > 1 else -LOW)
        return np.array(list(map(len, parts)), dtype=np.int64), np.concatenate(parts), found

    def _search(self, value: bytes) -> list[tuple[int, np.ndarray]]:
        if value not in self.searched:
            if len(self.searched) > 100_000:  # bounded; results do not depend on it
                self.searched.clear()
            self.searched[value] = [(s, np.array(ids, dtype=np.int32))
                                    for s, ids in self.lattice.n_best(value.decode(), self.n)]
        return self.searched[value]

    def segment(self, column: pa.Array):
        """Yields (row, rank, score, ids) of every text's N best, best first; null is empty.

        A text with fewer segmentations has fewer; the empty text has one, without ids.
        """
        column = pc.fill_null(column, "").cast(pa.large_string())
        column = pc.replace_substring(column, MARK, " ")
        blank, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
        marked = pc.if_else(pc.equal(pc.binary_length(column), 0), column,
                            pc.binary_join_element_wise(blank, column, none))
        pieces = ragged.chunks(ragged.text_of(marked), ragged.SPACE)
        values = pieces.values.to_pylist()
        rows = self.memo.rows(values)
        bounds, ids = self.memo.gather(pieces, rows)
        row_of = rows[pieces.codes] if len(pieces.codes) else pieces.codes
        lengths = self.memo.lengths[row_of]
        token_ends = np.concatenate([[0], np.cumsum(lengths)])
        scores = np.concatenate([[0], np.cumsum(self.memo.extra[row_of, 0])])
        gaps = self.memo.extra[row_of, 1]
        for i in range(len(column)):
            lo, hi = int(pieces.bounds[i]), int(pieces.bounds[i + 1])
            score = int(scores[hi] - scores[lo])
            own = ids[bounds[i]:bounds[i + 1]]
            chosen = self._least(gaps[lo:hi]) + lo
            lists = [self._search(values[pieces.codes[k]]) for k in chosen.tolist()]
            # sums of one choice for each chosen occurrence, the N greatest
            sums = [(0, ())]
            for options in lists:
                sums = heapq.nsmallest(self.n, ((loss + options[0][0] - s, (*picks, p)) for loss, picks in sums
                                                for p, (s, _) in enumerate(options)))
            order = np.argsort(chosen, kind="stable").tolist()
            for rank, (loss, picks) in enumerate(sums, 1):
                parts, at = [], bounds[i]
                for k in order:  # put the picked ids in their places
                    start, stop = token_ends[chosen[k]], token_ends[chosen[k] + 1]
                    parts += [ids[at:start], lists[k][picks[k]][1]]
                    at = stop
                yield i, rank, score - loss, np.concatenate([*parts, ids[at:bounds[i + 1]]]) if parts else own

    def _least(self, gaps: np.ndarray) -> np.ndarray:
        """Places of the N - 1 least gaps (earlier first among equals), of those that have a second best."""
        m = min(self.n - 1, len(gaps))
        if m <= 0:
            return np.zeros(0, dtype=np.int64)
        bar = np.partition(gaps, m - 1)[m - 1]
        at = np.flatnonzero(gaps <= bar)
        at = at[np.argsort(gaps[at], kind="stable")][:m]
        return at[gaps[at] < -LOW]


_LOADED: dict[tuple[str, int], Segmenter] = {}


def segmenter(path: str, n: int) -> Segmenter:
    if (path, n) not in _LOADED:
        _LOADED[path, n] = Segmenter(path, n)
    return _LOADED[path, n]


def n_best_segmentations(docs: DataFrame, model: str, n: int = 3, with_ids: bool = False) -> DataFrame:
    """Rows of each row of ``docs(doc_id, text)``: doc_id, rank, score, n_pieces, ids_crc32,
    decoded_bytes, decoded_crc32[, ids].

    ``rank`` runs from 1 to n, or to the number of segmentations a text has.  The
    last columns come from decoding the ids: the text itself, but for mark
    characters in it, which come back as blanks.
    """
    fields = [("doc_id", pa.int64()), ("rank", pa.int32()), ("score", pa.int64()), ("n_pieces", pa.int64()),
              ("ids_crc32", pa.int64()), ("decoded_bytes", pa.int64()), ("decoded_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches):
        segment = segmenter(model, n)
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                keys = part.column("doc_id").to_pylist()
                out = []
                for i, rank, score, ids in segment.segment(part.column("text")):
                    text = segment.lattice.decode(ids)
                    out.append((keys[i], rank, score, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(text),
                                zlib.crc32(text), *([ids.tolist()] * with_ids)))
                yield common.batch_of(schema, *zip(*out))

    kinds = ("doc_id long, rank int, score long, n_pieces long, ids_crc32 long, decoded_bytes long, decoded_crc32 long"
             + ", ids array<int>" * with_ids)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kinds)


def query(spark, sf_dir) -> DataFrame:
    """op9: the three best segmentations of all documents by piece_bpe_32k.model."""
    return n_best_segmentations(common.documents(spark, sf_dir), common.tokenizer_path("piece_bpe_32k.model"), 3)
