"""Operator 7: document fingerprints from spot signatures.

A spot signature is a common word (an anchor) with the chain of the next
``CHAIN`` content words after it; running prose is full of them, and tables, link
lists and boilerplate hold few.  The set of its signatures stands for a
document; its likeness to another is the sets' Jaccard value.  Sets are dealt by
length, since two sets of likeness t differ in length by a factor of t at most,
and compared with a bound that stops as soon as t is out of reach.

A text without any anchor takes every word as one, and a text too short for a
chain has its whole word sequence (or, wordless, its bytes) as its signature.
Empty texts have no signature: likeness 1 to each other, 0 to all else.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .components import connected_components

CHAIN = 2
TILE_ROWS = 1024
# Common function words of English, German, French and Spanish.
ANCHORS = frozenset(w.encode() for w in """
a an and are as at be by for from in is it of on or that the this to was with
das dem den der die ein eine es im ist mit nicht sich sie und von zu
au ce dans des du elle est et il la le les ne pas pour que qui sur un une
al como con de del el en las lo los no para por se su
""".split())
# words are runs of letters, digits and bytes above ASCII; ASCII capitals are folded
_WORD_BYTES = bytes(b | 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A or 0x30 <= b <= 0x39 else 32
                    for b in range(256))


def signatures(text: bytes) -> set[tuple[bytes, ...]]:
    """The spot signatures of a UTF-8 text."""
    words = text.translate(_WORD_BYTES).split()
    content = [w for w in words if w not in ANCHORS]
    found, seen, last = set(), 0, len(content) - CHAIN
    for w in words:
        if w not in ANCHORS:
            seen += 1
        elif seen <= last:
            found.add((w, *content[seen:seen + CHAIN]))
    if not found:
        found = set(zip(*(words[i:] for i in range(CHAIN + 1))))
    if not found and text:
        found = {tuple(words) or (text,)}
    return found


def fingerprint(found: set[tuple[bytes, ...]]) -> str:
    """Number of signatures and a digest of the set, in hex; the same for equal sets."""
    from xxhash import xxh3_128_intdigest

    total = sum(map(xxh3_128_intdigest, map(b"\0".join, found))) & ((1 << 128) - 1)
    return f"{len(found):x}-{total:032x}"


def likeness(a: set, b: set, least: float = 0.0) -> float:
    """Jaccard value of two sets, or 0 where it is below ``least``.

    Lengths alone bound it by the smaller over the larger, and while members are
    compared the most that can still be shared bounds it; both stop early.
    """
    if not a and not b:
        return 1.0
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not small or len(small) < least * len(large):
        return 0.0
    if least <= 0:
        shared = len(small & large)
    else:
        # shared / (both - shared) >= least  <=>  shared >= least * both / (1 + least)
        spare = len(small) - math.ceil(least * (len(a) + len(b)) / (1 + least) - 1e-9)
        for s in small:
            if s not in large:
                spare -= 1
                if spare < 0:
                    return 0.0
        shared = sum(s in large for s in small)
    return shared / (len(a) + len(b) - shared)


def _hashes(found: set[tuple[bytes, ...]]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.unique(np.fromiter(map(xxh64_intdigest, map(b"\0".join, found)), dtype=np.uint64, count=len(found)))


# --- near-duplicate search ----------------------------------------------------

def spot_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, n_signatures, signatures (sorted 64-bit hashes) of ``docs(doc_id, text)``."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string()), ("n_signatures", pa.int64()),
                        ("signatures", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for i, text in enumerate(batch.column("text")):
                found = signatures(text.as_py().encode() if text.is_valid else b"")
                yield common.batch_of(schema, [batch.column("doc_id")[i].as_py()], [fingerprint(found)], [len(found)],
                                      [_hashes(found).view(np.int64)])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(run, "doc_id long, fingerprint string, n_signatures long, signatures array<bigint>"))


def similar_documents(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, fingerprint, component_id: documents joined by likeness of ``least`` or more.

    Equal sets are one node, so copies make no pairs.  A node of length n lies in
    length class floor(log(n) / log(1 / least)); nodes that can reach ``least`` lie
    in the same class or in neighbouring ones, their lengths are within the factor
    ``least``, and they share one of their ``n - ceil(least * n) + 1`` rarest
    signatures.  Only such pairs of nodes are compared.  Every document has a row.
    """
    rows = common.stored(spot_fingerprints(docs), "spotsigs")
    nodes = common.stored(
        rows.where("n_signatures > 0").groupBy("fingerprint")
        .agg(F.first("signatures").alias("signatures"), F.first("n_signatures").alias("n"))
        .withColumn("node", F.xxhash64("fingerprint"))
        .withColumn("rank", F.floor(F.log(F.col("n")) / math.log(1 / least) + 1e-9).cast("int")), "spot-nodes")
    listed = nodes.select("node", "n", "rank", F.explode("signatures").alias("sig"))
    common_ness = listed.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("node").orderBy("df", "sig")
    rare = (listed.join(common_ness, "sig").where("df > 1").withColumn("place", F.row_number().over(order))
            .where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1))
    # a node meets its own class under that class's number, and the class above under the next
    met = (rare.select("node", "n", "sig", F.explode(F.array("rank", F.col("rank") + 1)).alias("length_class"))
           .withColumn("key", F.xxhash64("length_class", "sig")))
    groups = met.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    pairs = _candidates(met.join(groups, "key"), least)
    lists = nodes.select("node", "signatures")
    checked = (pairs.join(lists.withColumnRenamed("node", "u").withColumnRenamed("signatures", "a"), "u")
               .join(lists.withColumnRenamed("node", "v").withColumnRenamed("signatures", "b"), "v"))
    edges = checked.select("u", "v", "a", "b").mapInArrow(_alike(least), "u long, v long")
    labels = connected_components(edges)
    named = nodes.join(labels, "node", "left").select("fingerprint", F.coalesce("label", "node").alias("label"))
    found = rows.select("doc_id", "fingerprint").join(named, "fingerprint", "left")
    label = F.coalesce("label", F.lit(0))  # empty texts form one group
    ids = found.groupBy(label.alias("label")).agg(F.min("doc_id").alias("component_id"))
    return (found.withColumn("label", label).join(ids, "label").select("doc_id", "fingerprint", "component_id"))


def _alike(least: float):
    """For mapInArrow: the pairs (u, v) of rows (u, v, a, b) whose sets have likeness ``least`` or more."""

    def run(batches):
        for batch in batches:
            sides = [batch.column(c) for c in ("a", "b")]
            keep = [likeness(*(set(side[i].values.to_numpy().tolist()) for side in sides), least) > 0
                    for i in range(batch.num_rows)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, type=pa.bool_()))

    return run


def _tiles(met: DataFrame, tile_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of the comparison of the groups of ``met(key, node, n, m)``, by key and tile (i, j).

    A group of m rows is split by a hash into parts of about ``tile_rows``; tile (i, j) has the
    left rows of part i and the right rows of part j, so every pair meets in one tile.
    """
    parts = F.ceil(F.col("m") / tile_rows).cast("int")
    rows = met.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = rows.select("key", F.col("part").alias("i"), every.alias("j"), F.col("node").alias("u"), F.col("n").alias("u_n"))
    right = rows.select("key", every.alias("i"), F.col("part").alias("j"), F.col("node").alias("v"), F.col("n").alias("v_n"))
    return left, right


def _candidates(met: DataFrame, least: float, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Distinct pairs of nodes that meet under a key and whose lengths allow ``least``."""
    left, right = _tiles(met, tile_rows)
    near = F.least("u_n", "v_n") >= F.greatest("u_n", "v_n") * least - 1e-9
    return left.join(right, ["key", "i", "j"]).where((F.col("u") < F.col("v")) & near).select("u", "v").distinct()


# --- likeness to an edited text and to the next document ------------------------

_FIELDS = [("doc_id", "long"), ("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"),
           ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")]
_KINDS = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}


class _Seen:
    """A document with its signatures and fingerprint, worked out once."""

    def __init__(self, doc_id, text: str):
        self.doc_id, self.text = doc_id, text
        self.signatures = signatures(text.encode())
        self.fingerprint = fingerprint(self.signatures)


def _compared(own: _Seen, after: _Seen) -> tuple:
    """Result of a document, given the one after it."""
    third = len(own.text) // 3
    edited = own.text[:len(own.text) - third] + after.text[:third]
    data = edited.encode()
    found = signatures(data)
    return (own.doc_id, len(own.text), hashlib.sha256(data).hexdigest(), own.fingerprint, fingerprint(found),
            likeness(own.signatures, found), likeness(own.signatures, after.signatures))


def likeness_to_edits(docs: DataFrame, part_bytes: int = common.TARGET_BYTES) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: fingerprints of its text and its edited
    text, and its likeness to the edited text and to the next document.

    Documents are ordered by descending doc_id (null ids last, equal ids by a hash of
    the text) and dealt into ranges; a task walks its range with one document in
    hand.  The last row of a range is completed by the first row of the next
    range that has rows, and the very last by the very first.
    """
    edge = [("part", pa.int32()), ("head", pa.string()), ("tail", pa.string())]
    schema = pa.schema([(n, _KINDS[k]) for n, k in _FIELDS] + edge)

    def walk(batches):
        part, hand, first = TaskContext.get().partitionId(), None, None
        for batch in batches:
            done = []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                row = _Seen(doc_id.as_py(), text.as_py() if text.is_valid else "")
                if hand is None:
                    first = row.text
                else:
                    done.append(_compared(hand, row))
                hand = row
            if done:
                columns = list(zip(*done))
                yield common.batch_of(schema, *columns, [None] * len(done), [None] * len(done), [None] * len(done))
        if hand is not None:  # the edge of the range
            yield common.batch_of(schema, [hand.doc_id], *[[None]] * (len(_FIELDS) - 1), [part], [first], [hand.text])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    n_parts = common.parts_for(common.text_bytes(docs), part_bytes)
    ranged = (plain.repartitionByRange(n_parts, *order)
              .sortWithinPartitions(*order, "text").select("doc_id", "text"))
    fields = ", ".join(f"{n} {k}" for n, k in _FIELDS)
    walked = common.stored(ranged.mapInArrow(walk, f"{fields}, part int, head string, tail string"), "spot-walk")

    edges = walked.where("part is not null").select("doc_id", "part", "head", "tail")  # a row per range
    numbers = edges.select("part")
    after = numbers.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")),
                                              F.min("part").over(Window.orderBy("part"))).alias("after"))
    joined = (edges.select("doc_id", "part", "tail").join(after, "part")
              .join(edges.select(F.col("part").alias("after"), F.col("head").alias("next")), "after"))
    final = pa.schema([(n, _KINDS[k]) for n, k in _FIELDS])

    def complete(batches):
        for batch in batches:
            for doc_id, tail, following in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tail", "next"))):
                yield common.batch_of(final, *([v] for v in _compared(_Seen(doc_id, tail), _Seen(None, following))))

    # one row per range: a task takes many of them
    ends = joined.select("doc_id", "tail", "next").coalesce(-(-n_parts // 64)).mapInArrow(complete, fields)
    return walked.where("part is null").select(*(n for n, _ in _FIELDS)).union(ends)


def query(spark, sf_dir) -> DataFrame:
    """op7: fingerprints and likeness of all documents."""
    return likeness_to_edits(common.documents(spark, sf_dir))
