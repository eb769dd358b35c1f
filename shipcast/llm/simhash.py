"""Operator 2: near-duplicate documents by SimHash fingerprints.

Fingerprints are compared exactly, in tiles: distinct fingerprints are grouped by
each of ``radius + 1`` blocks of their 64 bits (two fingerprints that differ in
at most ``radius`` bits agree on one block at least), and inside a group the
fingerprints, ordered by population count, are compared tile by tile with numpy
exclusive-or and bit counts.  Tile pairs whose population counts differ by more
than the radius are skipped, since each differing bit changes the count by one.
A group above ``GROUP_LIMIT`` is split into tiles of one population count (and a
hash within it), and each pair of tiles in reach is compared in a task of its own.

What a tile yields is a spanning star per linked set, not all its pairs, so the
edges stay fewer than the fingerprints; components of the edges give the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, ragged
from .components import connected_components

SEED = 42
GROUP_LIMIT = 8192
TILE = 512
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32


def _fingerprint(words: list[bytes], shingle: int) -> int:
    """Bits set in over half of the shingles' XXH64 values, as a signed 64-bit number."""
    from xxhash import xxh64_intdigest

    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[at:at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, text_key, fp of every row of ``docs(doc_id, text)``.

    ``text_key`` is a 64-bit hash of the text.  ASCII capitals are folded; words
    are runs of non-white-space; a text with fewer words than a shingle is one
    shingle; null and wordless texts have fingerprint 0.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                text = ragged.text_of(part.column("text"))
                text.data = _FOLD[text.data]
                fps = [_fingerprint(text.row(i).split(), shingle) for i in range(len(text))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), part.column("text_key"), pa.array(fps, type=pa.int64())],
                    schema=schema)

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
            .mapInArrow(run, "doc_id long, text_key long, fp long"))


def _linked(values: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, int]]:
    """Sets of two or more linked fingerprints: (members, least member).

    A search from each fingerprint not yet reached: the frontier is compared, tile
    by tile, with what is left; everything in reach joins the frontier.
    """
    counts = np.bitwise_count(values)
    order = np.argsort(counts, kind="stable")
    left, left_counts = values[order], counts[order].astype(np.int64)
    while len(left) > 1:
        members = [left[:1]]
        frontier, f_counts = left[:1], left_counts[:1]
        left, left_counts = left[1:], left_counts[1:]
        while len(frontier) and len(left):
            reached = np.zeros(len(left), dtype=bool)
            for i in range(0, len(frontier), TILE):
                tile, low = frontier[i:i + TILE], f_counts[i:i + TILE]
                start = np.searchsorted(left_counts, low.min() - radius)
                stop = np.searchsorted(left_counts, low.max() + radius, side="right")
                for j in range(start, stop, TILE):
                    near = np.bitwise_count(tile[:, None] ^ left[None, j:min(j + TILE, stop)]) <= radius
                    reached[j:min(j + TILE, stop)] |= near.any(axis=0)
            frontier, f_counts = left[reached], left_counts[reached]
            by = np.argsort(f_counts, kind="stable")
            frontier, f_counts = frontier[by], f_counts[by]
            members.append(frontier)
            left, left_counts = left[~reached], left_counts[~reached]
        found = np.concatenate(members)
        if len(found) > 1:
            yield found, found.min()


def _edges_of_groups(radius: int):
    """Task function: edges of tiles whose rows come sorted by tile key."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def edges(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.append(starts, len(keys)))
        us, vs = [], []
        small = np.repeat(sizes <= 8, sizes)  # many small tiles at once, by distance in the order
        k, x = keys[small], values[small]
        for lag in range(1, 8):
            near = (k[lag:] == k[:-lag]) & (np.bitwise_count(x[lag:] ^ x[:-lag]) <= radius)
            us.append(x[lag:][near])
            vs.append(x[:-lag][near])
        for start, size in zip(starts[sizes > 8].tolist(), sizes[sizes > 8].tolist()):
            for found, least in _linked(np.unique(values[start:start + size]), radius):
                us.append(found)
                vs.append(np.full(len(found), least))
        u, v = (np.concatenate(p).view(np.int64) for p in (us, vs))
        keep = u != v
        return pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], schema=schema)

    def run(batches):
        rest_k, rest_v = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        for batch in batches:
            keys = np.concatenate([rest_k, batch.column("tile").to_numpy()])
            values = np.concatenate([rest_v, batch.column("fp").to_numpy().view(np.uint64)])
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1]))  # the last tile may go on in the next batch
            rest_k, rest_v = keys[last:], values[last:]
            if last:
                yield edges(keys[:last], values[:last])
        if len(rest_k):
            yield edges(rest_k, rest_v)

    return run


def links(nodes: DataFrame, radius: int, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Edges (u, v) that connect all fingerprints ``nodes(fp)`` differing in at most ``radius`` bits."""
    width = 64 // (radius + 1)
    blocks = []
    for b in range(radius + 1):
        bits = width if b < radius else 64 - width * radius
        block = F.shiftrightunsigned("fp", b * width).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1))
        blocks.append(F.struct(F.lit(b).alias("block"), block.alias("bits")))
    placed = (nodes.select("fp", F.explode(F.array(*blocks)).alias("at"))
              .select("fp", "at.block", "at.bits", F.bit_count("fp").alias("ones")))
    per_count = placed.groupBy("block", "bits", "ones").agg(F.count(F.lit(1)).alias("n"))
    groups = per_count.groupBy("block", "bits").agg(F.sum("n").alias("size")).where("size > 1")
    rows = common.stored(placed.join(groups, ["block", "bits"]), "simhash-blocks")

    own = rows.where(F.col("size") <= group_limit).select(F.xxhash64("block", "bits").alias("tile"), "fp")
    # tiles of large groups: one population count each, split further by a hash
    tiles = (rows.where(F.col("size") > group_limit).groupBy("block", "bits", "ones").agg(F.count(F.lit(1)).alias("n"))
             .withColumn("split", F.ceil(F.col("n") / (group_limit // 2)).cast("int")).drop("n"))
    right = tiles.select("block", "bits", F.col("ones").alias("r_ones"), F.col("split").alias("r_split"))
    pairs = (tiles.withColumn("r_ones", F.explode(F.sequence(F.col("ones"), F.col("ones") + radius)))
             .join(right, ["block", "bits", "r_ones"])
             .withColumn("l", F.explode(F.sequence(F.lit(0), F.col("split") - 1)))
             .withColumn("r", F.explode(F.sequence(F.lit(0), F.col("r_split") - 1)))
             .where((F.col("ones") < F.col("r_ones")) | (F.col("l") <= F.col("r")))
             .withColumn("tile", F.xxhash64("block", "bits", "ones", "r_ones", "l", "r")))
    sides = pairs.select("block", "bits", F.explode(F.array_distinct(F.array(
        F.struct(F.col("ones"), F.col("split"), F.col("l").alias("sub")),
        F.struct(F.col("r_ones").alias("ones"), F.col("r_split").alias("split"), F.col("r").alias("sub"))))).alias("s"),
        "tile").select("block", "bits", "s.*", "tile")
    split = (rows.where(F.col("size") > group_limit)
             .join(sides, ["block", "bits", "ones"])
             .where(F.pmod(F.xxhash64("fp"), F.col("split")) == F.col("sub")).select("tile", "fp"))
    dealt = own.union(split).repartition("tile").sortWithinPartitions("tile", "fp")
    return dealt.mapInArrow(_edges_of_groups(radius), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """doc_id, text_key, fp, group, component_id of every row of ``docs(doc_id, text)``.

    Rows whose fingerprints are joined by links of at most ``radius`` differing
    bits form a group; ``group`` is its least fingerprint and ``component_id`` its
    least doc_id (null if all its ids are null).  Repeated rows are kept.
    """
    prints = common.stored(fingerprints(docs, shingle), "simhash")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    edges = common.stored(links(nodes.select("fp"), radius, group_limit), "simhash-links")
    labels = connected_components(edges).select(F.col("node").alias("fp"), F.col("label").alias("group"))
    known = nodes.join(labels, "fp", "left").withColumn("group", F.coalesce("group", "fp"))
    known = common.stored(known, "simhash-nodes")
    ids = known.groupBy("group").agg(F.min("least").alias("component_id"))
    return prints.join(known.select("fp", "group").join(ids, "group"), "fp").select(
        "doc_id", "text_key", "fp", "group", "component_id")


def keep_one_per_group(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the least doc_id, nulls last.

    Rows with equal ids in one group are told apart by a hash of their text; of
    rows equal in both, one stays.  All columns are kept as they are.
    """
    found = near_duplicates(docs, shingle, radius)
    first = found.groupBy("group").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first"))
    name = common.free_name(docs, "row_key")
    keys = first.select(F.xxhash64("first.doc_id", "first.text_key").alias(name)).distinct()
    keyed = docs.withColumn(name, F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")))
    return keyed.join(keys, name, "left_semi").dropDuplicates([name]).drop(name)


def query(spark, sf_dir) -> DataFrame:
    """op2: shingles of three words, links at two or fewer differing bits."""
    found = near_duplicates(common.documents(spark, sf_dir), 3, 2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
