"""Operator 8: language-model scores from a probabilistic suffix tree over words.

The tree's root is the add-one unigram distribution of all training tokens.  A
context of up to ``MAX_DEPTH`` words enters it if one of its continuations occurs at
least ``MIN_COUNT`` times in training, at any corpus size, and its next-symbol
distribution diverges from that of its longest suffix in the tree.  Rarer
continuations are folded into the escape weight, and distributions are interpolated
with the suffix's (absolute discounting), so every state's probabilities sum to one.
A token is scored in the state of the longest suffix of the words before it.

The model grows with the corpus.  Words and n-grams are known by a 64-bit hash; two of
one hash count as one.  All counts are over all training rows.

Blocks of documents are cut into words once and stay where they are (a table bucketed by
their home, and so are their answers: no pass shuffles what it has).  A home is a few
blocks in a row of one task: a task of a pass holds one home and its answers at a time,
however large the files' splits are.  What a block must know of the whole
corpus it asks for in passes: it sends, for each range of hashes, one row with its sorted
distinct hashes (differences, compressed) and what it adds to each; the task of a range
adds the rows up with numpy and answers each block in the block's own order.  One block
owns each hash, so what is added once for every n-gram is added by its owner.

* ``count``: training counts of words, then of the n-grams whose prefix and suffix both
  reach the count (an n-gram cannot be more frequent than those).
* ``mass``: for each context, the counts and number of its listed continuations.
* ``state``: for each context, its divergence from the longest suffix, summed over the
  continuations; the answer is whether it is a state.

Pass t asks for the counts of length t, the masses of length t - 1 and the states of
length t - 2.  A block holds the answers as short arrays and works probabilities out
again from them, the same in every block.  A word in every block adds one entry a block
to its range, as any other, never one an occurrence.  The driver sees totals only.
"""

from __future__ import annotations

import math
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fresh_table
from . import common, ragged

MIN_COUNT = 2
MAX_DEPTH = 4
DISCOUNT = 0.75
BLOCK_BYTES = 4 << 20  # arrays of a block take some twenty times as much
HOME_BYTES = 16 << 20  # texts and ids of a home
RANGE_TOKENS = 2_000_000  # tokens of the corpus for each range of hashes
LEAST_RANGES = 64
MAX_BUCKETS = 50_000
END = 1  # hash of the end symbol
TINY = 1e-12  # least escape weight of a state
COUNT, MASS, STATE = range(3)
_WIDTH = {COUNT: 2, MASS: 2, STATE: 1}  # columns of an answer
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32


def _pack(*columns: np.ndarray) -> bytes:
    """Compressed bytes of arrays of one length, whole numbers in the least width that holds them.

    All first bytes of an array's items go before all second ones."""
    import zstandard

    sizes, planes = [], []
    for values in columns:
        values = np.ascontiguousarray(values)
        if values.dtype.kind in "iu" and len(values) and values.min() >= 0:
            values = values.astype(np.min_scalar_type(values.max()), copy=False)
        sizes.append(values.itemsize)
        planes.append(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).reshape(-1))
    head = np.array([len(sizes), *sizes], dtype=np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([head, *planes]))


def _unpack_all(data: bytes, dtype) -> list[np.ndarray]:
    import zstandard

    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    sizes = data[1:data[0] + 1].tolist()
    at, n, out = len(sizes) + 1, (len(data) - len(sizes) - 1) // sum(sizes), []
    for size in sizes:
        planes = np.ascontiguousarray(data[at:at + n * size].reshape(size, n).T).reshape(-1)
        at += n * size
        full = size == np.dtype(dtype).itemsize
        out.append(planes.view(dtype) if full else planes.view(f"u{size}").astype(dtype))
    return out


def _unpack(data: bytes, dtype) -> np.ndarray:
    return _unpack_all(data, dtype)[0]


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


# --- blocks -------------------------------------------------------------------------

_BLOCK = [("home", pa.int64()), ("block", pa.int64()), ("tokens", pa.int64()), ("trained", pa.int64()),
          ("doc_ids", pa.binary()), ("nulls", pa.binary()), ("held", pa.binary()), ("bounds", pa.binary()),
          ("codes", pa.binary()), ("keys", pa.binary())]
_BLOCK_KINDS = "home long, block long, tokens long, trained long, " + ", ".join(f"{n} binary" for n, _ in _BLOCK[4:])


def _cut(docs: DataFrame, held, buckets: int) -> DataFrame:
    """A row per block of documents: its tokens as places in the sorted hashes of its distinct words.

    Every document ends with the end symbol."""
    schema = pa.schema(_BLOCK)

    def run(batches):
        import xxhash

        home = block = TaskContext.get().partitionId() << 24
        held_bytes = 0
        for batch in batches:
            for part in ragged.slices(batch, "text", BLOCK_BYTES):
                block += 1
                pa.default_memory_pool().release_unused()
                text = ragged.text_of(part.column("text"))
                text.data = _FOLD[text.data]
                size = len(text.data) + 8 * len(text)
                if held_bytes and held_bytes + size > HOME_BYTES:
                    home, held_bytes = home + 1, 0
                held_bytes += size
                found = ragged.words(text)
                hashes = np.fromiter(map(xxhash.xxh64_intdigest, found.values.to_pylist()), dtype=np.uint64,
                                     count=len(found.values))
                hashes[hashes <= END] += np.uint64(2)
                keys, place = np.unique(np.append(hashes, np.uint64(END)), return_inverse=True)
                bounds = found.bounds + np.arange(len(found.bounds))
                inside = np.ones(int(bounds[-1]), dtype=bool)
                inside[bounds[1:] - 1] = False
                codes = np.full(len(inside), place[-1], dtype=np.int32)
                codes[inside] = place[found.codes]
                out = part.column("held").to_numpy(zero_copy_only=False)
                ids = part.column("doc_id")
                yield common.batch_of(
                    schema, [home], [block], [len(codes)], [int(np.diff(bounds)[~out].sum())],
                    [_pack(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))],
                    [_pack(ids.is_null().to_numpy(zero_copy_only=False))], [_pack(out)],
                    [_pack(bounds.astype(np.int64))], [_pack(codes)], [_pack_sorted(keys)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), "text")
    return _bucketed(rows.mapInArrow(run, _BLOCK_KINDS), buckets, fresh_table(docs.sparkSession, "lm_blocks"))


# --- n-grams of a block, and what it knows of them -------------------------------------

def _sorted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the hashes in ascending order, and the hashes in it.

    Sorts their leading bits with the place in the bits below, which is faster than argsort; should hashes
    differ in the bits below only, and not come out in order, argsort it is."""
    low = np.uint64(max(len(hashes) - 1, 1).bit_length())
    packed = hashes >> low << low
    packed |= np.arange(len(hashes), dtype=np.uint64)
    packed.sort()
    packed &= (np.uint64(1) << low) - np.uint64(1)
    order = packed.view(np.int64)
    found = hashes[order]
    if not np.all(found[1:] >= found[:-1]):
        order = np.argsort(hashes)
        found = hashes[order]
    return order, found


def _grouped(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, a place of each among ``hashes``, and the number of each place's hash."""
    order, hashes = _sorted(hashes)
    new = np.ones(len(hashes), dtype=bool)
    np.not_equal(hashes[1:], hashes[:-1], out=new[1:])
    number = np.empty(len(hashes), dtype=np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return hashes[new], order[new], number


def _longer(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of n-grams from those of all words but the last and of the last word."""
    h = context * np.uint64(0x9E3779B97F4A7C15) + word
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        h ^= h >> np.uint64(31)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(32))


class _Length:
    """The distinct n-grams of one length in a block whose prefix and suffix reach the count.

    ``keys`` sorted hashes; ``context``, ``suffix`` places in the length before.  Unanswered: ``n``,
    training counts in the block.  With answers: ``c`` counts in the corpus, ``own``, ``listed`` (reaches
    the count), ``at`` each token's place (-1 where its n-gram is not listed), ``p`` probabilities, and of
    each n-gram as a context: ``mass`` (sum of counts), ``entries``, ``escape`` and ``state``.
    """

    def __init__(self, keys, context, suffix):
        self.keys, self.context, self.suffix = keys, context, suffix
        self.n = self.c = self.at = self.p = self.mass = self.state = None


def _lengths(row: dict, got: dict, least: int, depth: int, n_total: int, v: int, scored: bool = False) -> list[_Length]:
    """Lengths 0 to ``depth`` of a block, as far as the answers ``got`` by (kind, length) reach (taken out of it).

    If they are to be ``scored``, ``at`` is kept, and what only requests read is not."""
    bounds, codes = _unpack(row["bounds"], np.int64), _unpack(row["codes"], np.int32)
    keys = _unpack_sorted(row["keys"])
    words = hashes = keys[codes]
    places, context, suffix, out = slice(None), None, None, []
    for k in range(depth + 1):
        if k:
            last = out[-1]
            listed = last.at >= 0
            follows = listed.copy()
            follows[1:] &= listed[:-1]
            follows[bounds[:-1]] = False
            places = np.flatnonzero(follows)
            grams = _longer(hashes[places - 1], words[places])
            keys, first, codes = _grouped(grams)
            first = places[first]
            context, suffix = last.at[first - 1], last.at[first]
            hashes = np.empty(len(words), dtype=np.uint64)  # read only where an n-gram is listed
            hashes[places] = grams
            if not scored:
                last.at = None
        new = _Length(keys, context, suffix)
        out.append(new)
        if (COUNT, k) not in got:
            train = np.repeat(~_unpack(row["held"], bool), np.diff(bounds))
            new.n = np.bincount(codes, weights=train[places], minlength=len(keys)).astype(np.int64)
            break
        new.c, own = got.pop((COUNT, k))
        new.own = own > 0
        new.listed = (new.c >= least) | ((new.keys == END) if k == 0 else False)
        if k < depth or scored:
            new.at = np.full(len(words), -1, dtype=np.int32)
            new.at[places] = np.where(new.listed, np.arange(len(keys), dtype=np.int32), np.int32(-1))[codes]
        if scored:
            new.keys = new.own = None
    for k, new in enumerate(out[:-1]):
        if (MASS, k + 1) in got:
            new.mass, new.entries = (np.zeros(len(new.c), dtype=np.int64) for _ in range(2))
            new.mass[new.listed], new.entries[new.listed] = got.pop((MASS, k + 1))
            new.escape = _escape(new.c, new.mass, new.entries)
        if (STATE, k + 1) in got:
            new.state = np.zeros(len(new.c), dtype=bool)
            new.state[new.entries > 0] = got[STATE, k + 1][0] > 0
        if scored:
            new.mass = new.entries = new.listed = None
    for k, new in enumerate(out):
        if k == 0 and new.c is not None:
            new.p = (new.c + 1.0) / float(n_total + v + 1)
        elif k and out[k - 1].state is not None:
            own, parent = _weights(new, out[k - 1])
            new.p = np.where(out[k - 1].state[new.context], own, parent)
            if scored:
                new.context = new.suffix = None
    return out


def _escape(total: np.ndarray, mass: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return 1.0 - (mass - DISCOUNT * entries) / np.maximum(total, 1)


def _weights(new: _Length, last: _Length) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of n-grams in their context were it a state, and in its suffix."""
    parent = last.p[new.suffix]
    return np.maximum(new.c - DISCOUNT, 0.0) / np.maximum(last.c[new.context], 1) + last.escape[new.context] * parent, parent


# --- passes: requests of blocks, answers of ranges ---------------------------------------

_ASK = [("home", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("length", pa.int32()), ("part", pa.int64()),
        ("keys", pa.binary()), ("columns", pa.binary())]
_ASK_KINDS = "home long, block long, kind int, length int, part long, keys binary, columns binary"
_ANSWER = [*_ASK[:5], ("fresh", pa.int64()), ("columns", pa.binary())]
_ANSWER_KINDS = "home long, block long, kind int, length int, part long, fresh long, columns binary"


def _requests(lengths: list[_Length], kind: int, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted hashes a block asks about, and what it adds to each."""
    new = lengths[k]
    if kind == COUNT:
        return new.keys, [new.n]
    last = lengths[k - 1]
    mine = new.own & new.listed  # every n-gram is added once in the corpus
    of, size = new.context[mine], len(last.keys)
    if kind == MASS:
        mass = np.bincount(of, weights=new.c[mine], minlength=size).astype(np.int64)
        return last.keys[last.listed], [mass[last.listed], np.bincount(of, minlength=size)[last.listed]]
    own, parent = (x[mine] for x in _weights(new, last))
    gain = np.bincount(of, weights=last.c[of] * own * np.log(own / parent), minlength=size)
    listed = np.bincount(of, weights=parent, minlength=size)
    asked = last.entries > 0
    once = [np.where(last.own, x, 0)[asked] for x in (last.c, last.mass, last.entries)]
    return last.keys[asked], [gain[asked].view(np.int64), listed[asked].view(np.int64), *once]


def _answers(right: pa.Table) -> dict:
    """Answers of a home by block, then by (kind, length), compressed, in the order of the block's hashes.

    A block that asked about nothing in a step has no answer to it."""
    rows = right.select(["block", "kind", "length", "part", "columns"]).sort_by(
        [("block", "ascending"), ("kind", "ascending"), ("length", "ascending"), ("part", "ascending")]).to_pydict()
    pieces: dict = {}
    for block, kind, length, data in zip(rows["block"], rows["kind"], rows["length"], rows["columns"]):
        pieces.setdefault(block, {}).setdefault((kind, length), []).append(data)
    return pieces


def _of_block(known: dict, block: int, done: list[tuple[int, int]]) -> dict:
    """A block's answers to all the steps that are done."""
    mine, out = known.pop(block, {}), {}
    for kind, k in done:
        width = _WIDTH[kind]
        found = [_unpack_all(x, np.int64) for x in mine.pop((kind, k), [])]
        out[kind, k] = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, dtype=np.int64)] * width
    return out


def _state_bits(gain, listed, total, mass, entries) -> np.ndarray:
    """Whether contexts are states: total times the divergence, of listed symbols and of all others at once."""
    escape = _escape(total, mass, entries)
    rest = np.maximum(escape * (1.0 - listed), 0.0)
    return gain + total * rest * np.log(np.maximum(escape, TINY)) >= 2.0 * (entries + 1)


def _add_up(group: pa.Table, least: int) -> pa.Table:
    """Answers of one range of hashes and one step."""
    pa.default_memory_pool().release_unused()
    group = group.sort_by("block")  # sums of floats, and owners, in one order
    kind, k = group.column("kind")[0].as_py(), group.column("length")[0].as_py()
    keys = [_unpack_sorted(x) for x in group.column("keys").to_pylist()]
    bounds = np.cumsum([0, *map(len, keys)])
    columns = [np.concatenate(x) for x in zip(*(_unpack_all(x, np.int64) for x in group.column("columns").to_pylist()))]
    _, first, inverse = _grouped(np.concatenate(keys))

    def total(i, floats=False):
        sums = np.bincount(inverse, weights=columns[i].view(np.float64) if floats else columns[i], minlength=len(first))
        return sums if floats else sums.astype(np.int64)

    fresh = np.zeros(bounds[-1], dtype=np.int64)
    if kind == COUNT:
        c = total(0)
        fresh[first] = c > 0
        own = np.zeros(bounds[-1], dtype=np.int64)
        own[first] = 1
        found = [(c if k == 0 else np.where(c >= least, c, 0))[inverse], own]
    elif kind == MASS:
        found = [total(0)[inverse], total(1)[inverse]]
    else:
        bits = _state_bits(total(0, True), total(1, True), total(2), total(3), total(4))
        found = [bits.astype(np.int64)[inverse]]
    counted = np.concatenate([[0], np.cumsum(fresh)])
    return pa.Table.from_arrays(
        [*(group.column(n).combine_chunks() for n, _ in _ASK[:5]), pa.array(counted[bounds[1:]] - counted[bounds[:-1]]),
         pa.array([_pack(*(x[a:b] for x in found)) for a, b in zip(bounds[:-1], bounds[1:])], type=pa.binary())],
        schema=pa.schema(_ANSWER))


def _pass(blocks: DataFrame, answers: DataFrame, done: list[tuple[int, int]], steps: list[tuple[int, int]], parts: int,
          buckets: int, least: int, n_total: int, v: int) -> DataFrame:
    """Ask for ``steps`` of (kind, length) with the answers to those ``done``."""
    reach = max(k for _, k in steps)
    starts = np.array([-(-(j << 32) // parts) << 32 for j in range(parts)], dtype=np.uint64)
    schema = pa.schema(_ASK)

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        known, out = _answers(right), []
        for i in range(left.num_rows):
            pa.default_memory_pool().release_unused()
            row = left.slice(i, 1).to_pylist()[0]
            lengths = _lengths(row, _of_block(known, row["block"], done), least, reach, n_total, v)
            for kind, k in steps:
                keys, columns = _requests(lengths, kind, k)
                cuts = np.append(np.searchsorted(keys, starts), len(keys))
                full = np.flatnonzero(np.diff(cuts))
                out.append(pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(full), x), type=t.type) for x, t in zip((row["home"], row["block"], kind, k), schema)]
                    + [pa.array(full, type=pa.int64()),
                       pa.array([_pack_sorted(keys[cuts[j]:cuts[j + 1]]) for j in full], type=pa.binary()),
                       pa.array([_pack(*(x[cuts[j]:cuts[j + 1]] for x in columns)) for j in full], type=pa.binary())], schema=schema))
        return pa.Table.from_batches(out, schema=schema)

    asked = blocks.groupBy("home").cogroup(answers.groupBy("home")).applyInArrow(ask, _ASK_KINDS)
    told = asked.groupBy("part", "kind", "length").applyInArrow(lambda group: _add_up(group, least), _ANSWER_KINDS)
    return told.repartition(buckets, "home")


def _bucketed(rows: DataFrame, buckets: int, place: tuple[str, str]) -> DataFrame:
    """The rows added to a table in buckets by home: what groups it by home reads it without a shuffle."""
    table, path = place
    rows.write.mode("append").bucketBy(buckets, "home").option("path", path).format("parquet").saveAsTable(table)
    return rows.sparkSession.table(table)


@contextmanager
def _short_shuffles(spark):
    """Shuffle files of a job go when the job is done: its result is a written table."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


# --- scores -----------------------------------------------------------------------------

def _token_scores(lengths: list[_Length], bounds: np.ndarray, base: np.ndarray) -> np.ndarray:
    """log10 probability of every token: its n-gram's at the longest listed length, and the escapes on the way there."""
    out, todo = np.zeros(len(base)), np.ones(len(base), dtype=bool)
    for k in range(len(lengths) - 1, 0, -1):
        new, last = lengths[k], lengths[k - 1]
        hit = todo & (new.at >= 0)
        out[hit] += np.log10(new.p[new.at[hit]])
        todo &= ~hit
        context = np.append(np.int32(-1), last.at[:-1])
        context[bounds[:-1]] = -1
        weights = np.zeros(len(last.state))
        weights[last.state] = np.log10(np.maximum(last.escape[last.state], TINY))
        leave = todo & (context >= 0)
        out[leave] += weights[context[leave]]
    out[todo] += base[todo]
    return out


def _row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of rows, each added up on its own; no row is empty."""
    return np.add.reduceat(values, bounds[:-1])


def suffix_tree_scores(docs: DataFrame, held, min_count: int = MIN_COUNT, max_depth: int = MAX_DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs(doc_id, text)``.

    ``held`` is a boolean column expression; rows where it is true teach nothing.
    ASCII capitals are folded, tokens are runs of non-white-space and one end per
    row.  Null text is empty: its end alone.  Without training rows both scores
    are those of a uniform choice among one token: 0.
    """
    spark = docs.sparkSession
    with _short_shuffles(spark):
        buckets = max(1, min(docs.rdd.getNumPartitions(), MAX_BUCKETS))
        blocks = _cut(docs, held, buckets)
        tokens, n = (x or 0 for x in blocks.agg(F.sum("tokens"), F.sum("trained")).first())
        parts = max(LEAST_RANGES, -(-tokens // RANGE_TOKENS))
        answers, v, done = spark.createDataFrame([], _ANSWER_KINDS), 0, []
        place = fresh_table(spark, "lm_answers")
        for t in range(max_depth + 3):
            steps = [(kind, t - kind) for kind in (COUNT, MASS, STATE) if (0 if kind == COUNT else 1) <= t - kind <= max_depth]
            told = _pass(blocks, answers, list(done), steps, parts, buckets, min_count, n, v)
            answers = _bucketed(told, buckets, place)
            done += steps
            if t == 0:
                v = answers.agg(F.sum("fresh")).first()[0] or 0

    log_n = math.log10(n + v + 1)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        known, out = _answers(right), []
        for i in range(left.num_rows):
            pa.default_memory_pool().release_unused()
            row = left.slice(i, 1).to_pylist()[0]
            lengths = _lengths(row, _of_block(known, row["block"], done), min_count, max_depth, n, v, scored=True)
            bounds, codes = _unpack(row["bounds"], np.int64), _unpack(row["codes"], np.int32)
            base = (np.log10(lengths[0].c + 1.0) - log_n)[codes]
            taught = np.concatenate([[0], np.cumsum(lengths[0].c[codes] > 0)])[bounds]
            out.append(pa.RecordBatch.from_arrays(
                [pa.array(_unpack(row["doc_ids"], np.int64), mask=_unpack(row["nulls"], bool)),
                 pa.array(_unpack(row["held"], bool)), pa.array(np.diff(bounds)), pa.array(np.diff(taught)),
                 pa.array(np.full(len(bounds) - 1, n, dtype=np.int64)), pa.array(_row_sums(base, bounds)),
                 pa.array(_row_sums(_token_scores(lengths, bounds, base), bounds))], schema=schema))
        return pa.Table.from_batches(out, schema=schema)

    return blocks.groupBy("home").cogroup(answers.groupBy("home")).applyInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
               "score double")


def query(spark, sf_dir) -> DataFrame:
    """op8: scores of all documents; rows with crc32(doc_id) mod 7 = 2 are held out."""
    docs = common.documents(spark, sf_dir)
    return suffix_tree_scores(docs, common.crc32_held(F.col("doc_id"), 7, 2))
