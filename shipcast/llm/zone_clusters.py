"""Operator 12: centroid clustering over zone maps along a space-filling curve.

Vectors are turned into integers, put in the order of a Hilbert curve and cut into
blocks that carry the least and the largest value of every component.  In a round,
a block's box bounds its members' distance to each centroid from below and from
above: centroids whose least distance exceeds the smallest largest distance are
left out for the whole block, and the members are compared exactly with the rest.
The blocks are written once and read by every round; a round returns a sum for
each cluster and task, and the centroids (a few vectors) go through the driver.

All sums and distances are whole numbers, so the result does not depend on the
order or number of tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vectors

SCALE = 64
LENGTH = 64
CLUSTERS = 16
ROUNDS = 3
BLOCK_ROWS = 256
PART_ROWS = 4096  # rows of a range of the curve, at the least
MAX_PARTS = 200_000  # ranges; beyond, they hold more rows
LIMIT = 1 << 26  # components; 64 squared differences of twice that still fit a long
EXACT_FLOAT = 1 << 22  # products and sums of 64 such components are whole in a double
CURVE_BITS = 2


def whole_numbers(rows: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of every component."""
    found = np.floor(rows.astype(np.float64) * scale)
    if found.size and np.abs(found).max() >= LIMIT:
        raise OverflowError(f"a component times {scale} is outside +-{LIMIT}: exact distances would not fit a long")
    return found.astype(np.int64)


def hilbert_index(grid: np.ndarray, bits: int) -> np.ndarray:
    """Place of each grid cell (rows of ``bits``-bit coordinates) on the Hilbert curve.

    Returns the index as bit columns, most significant first.  The coordinates are
    turned to the transposed index plane by plane: where a coordinate's bit is set
    the lower bits of the first coordinate are inverted, else exchanged with it.
    """
    x = grid.astype(np.int64).copy()
    n, dim = x.shape
    for plane in range(bits - 1, 0, -1):
        q, lower = 1 << plane, (1 << plane) - 1
        for i in range(dim):
            on = (x[:, i] & q) != 0
            x[on, 0] ^= lower
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & lower)
            x[:, 0] ^= swap
            x[:, i] ^= swap
    x = np.bitwise_xor.accumulate(x, axis=1) if dim else x  # Gray code along the coordinates
    turn = np.zeros(n, dtype=np.int64)
    if dim:
        for plane in range(bits - 1, 0, -1):
            turn ^= np.where((x[:, dim - 1] & (1 << plane)) != 0, (1 << plane) - 1, 0)
        x ^= turn[:, None]
    planes = [(x >> plane) & 1 for plane in range(bits - 1, -1, -1)]
    return np.concatenate(planes, axis=1).astype(np.uint8) if n else np.zeros((0, bits * dim), dtype=np.uint8)


def box_bounds(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest squared distance from each centroid to a point of the box."""
    under, over = low - centroids, centroids - high
    least = np.maximum(np.maximum(under, over), 0)
    most = np.maximum(np.abs(under), np.abs(over))
    return (least * least).sum(axis=1), (most * most).sum(axis=1)


def nearest(rows: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to each row's nearest centroid, ties to the smaller number."""
    least, most = box_bounds(low, high, centroids)
    near = np.flatnonzero(least <= most.min())
    chosen = centroids[near]
    if max(np.abs(rows).max(initial=0), np.abs(chosen).max(initial=0)) < EXACT_FLOAT:
        a, b = rows.astype(np.float64), chosen.astype(np.float64)
        d = (((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :]) - 2 * (a @ b.T)).astype(np.int64)
    else:
        d = ((rows[:, None, :] - chosen[None, :, :]) ** 2).sum(axis=2)
    at = d.argmin(axis=1)
    return near[at], d[np.arange(len(rows)), at]


def blocks_of(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", length: int = LENGTH,
              scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of vectors near each other: ids, rows (as bytes of 32-bit integers), low, high."""
    v = F.col(vector)
    kept = df.where(vectors.finite(vector) & (F.size(vector) == length)).select(
        F.col(vec_id).cast("long").alias("vec_id"), v.cast("array<double>").alias("vec"))
    sampled = vectors.sample(kept, "vec_id", "vec")
    cells = 1 << CURVE_BITS
    # grid lines of the curve: quantiles of the sample, so that dense ranges get as many cells as sparse ones
    lines = (np.quantile(sampled, [i / cells for i in range(1, cells)], axis=0) if len(sampled)
             else np.zeros((cells - 1, length)))

    def place(batches):
        schema = pa.schema([("vec_id", pa.int64()), ("rows", pa.binary()), ("curve", pa.binary())])
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                rows = vectors.matrix(part.column("vec"))
                grid = (rows[None, :, :] > lines[:, None, :]).sum(axis=0)
                curve = np.packbits(hilbert_index(grid, CURVE_BITS), axis=1)
                numbers = whole_numbers(rows, scale)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), pa.array([r.tobytes() for r in numbers.astype(np.int32)], type=pa.binary()),
                     pa.array([c.tobytes() for c in curve], type=pa.binary())], schema=schema)

    parts = max(1, min(-(-kept.count() // PART_ROWS), MAX_PARTS))
    ordered = (kept.mapInArrow(place, "vec_id long, rows binary, curve binary")
               .repartitionByRange(parts, "curve", "rows", "vec_id").sortWithinPartitions("curve", "rows", "vec_id"))

    def cut(batches):
        def block(ids, raw):
            rows = np.frombuffer(b"".join(raw), dtype=np.int32).reshape(len(raw), length)
            return pa.RecordBatch.from_pydict(
                {"ids": [ids], "rows": [rows.tobytes()], "low": [rows.min(axis=0).tolist()], "high": [rows.max(axis=0).tolist()]},
                schema=schema)

        schema = pa.schema([("ids", pa.list_(pa.int64())), ("rows", pa.binary()), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64()))])
        ids, raw = [], []
        for batch in batches:
            ids += batch.column("vec_id").to_pylist()
            raw += batch.column("rows").to_pylist()
            while len(ids) >= block_rows:
                yield block(ids[:block_rows], raw[:block_rows])
                ids, raw = ids[block_rows:], raw[block_rows:]
        if ids:
            yield block(ids, raw)

    return common.stored(ordered.mapInArrow(cut, "ids array<bigint>, rows binary, low array<bigint>, high array<bigint>"), "zone-blocks")


def _each_block(batches, length: int):
    for batch in batches:
        low, high = vectors.matrix(batch.column("low")), vectors.matrix(batch.column("high"))
        for i, (ids, raw) in enumerate(zip(batch.column("ids"), batch.column("rows").to_pylist())):
            yield ids.values, np.frombuffer(raw, dtype=np.int32).reshape(-1, length).astype(np.int64), low[i], high[i]


def first_centroids(blocks: DataFrame, k: int, length: int) -> np.ndarray:
    """The k vectors with the least sha256 of '1:<vec_id>'; rows without an id come last, equal ids by their components."""
    def run(batches):
        schema = pa.schema([("vec_id", pa.int64()), ("vec", pa.list_(pa.int64()))])
        for ids, rows, _, _ in _each_block(batches, length):
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), vectors.lists(rows, pa.int64())], schema=schema)

    each = blocks.mapInArrow(run, "vec_id long, vec array<bigint>")
    digest = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    picked = each.orderBy(digest.asc_nulls_last(), "vec").limit(k).collect()  # k rows
    return np.array([r["vec"] for r in picked], dtype=np.int64).reshape(len(picked), length)


def _round(blocks: DataFrame, centroids: np.ndarray, length: int) -> np.ndarray:
    """Centroids after one assignment: the floor of each cluster's mean; empty ones stay."""
    def run(batches):
        schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
        counts = np.zeros(len(centroids), dtype=np.int64)
        sums = np.zeros((len(centroids), length), dtype=np.int64)

        def gathered():
            there = np.flatnonzero(counts)
            return pa.RecordBatch.from_arrays(
                [pa.array(there, type=pa.int32()), pa.array(counts[there]), vectors.lists(sums[there], pa.int64())], schema=schema)

        for _, rows, low, high in _each_block(batches, length):
            at, _ = nearest(rows, low, high, centroids)
            counts += np.bincount(at, minlength=len(centroids))
            np.add.at(sums, at, rows)
            if counts.max() > 1 << 32:  # before a sum could leave 64 bits
                yield gathered()
                counts[:], sums[:] = 0, 0
        yield gathered()

    found = blocks.mapInArrow(run, "cluster int, n long, sums array<bigint>")
    wide = found.groupBy("cluster").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(length)])
    after = centroids.copy()
    for r in wide.collect():  # a row per cluster
        after[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(length)]
    return after


def cluster(df: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, length: int = LENGTH,
            block_rows: int = BLOCK_ROWS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector.

    Kept are vectors of ``length`` components, none null or non-finite; each row of
    a repeated vector or id is kept.  A row without an id is clustered but starts
    no centroid before those with one.  With fewer than ``k`` vectors there are as
    many centroids as vectors; no kept vector, no rows.
    """
    spark = df.sparkSession
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    blocks = blocks_of(df, vec_id, vector, length, scale, block_rows)
    centroids = first_centroids(blocks, k, length)
    if not len(centroids):
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        centroids = _round(blocks, centroids, length)

    def assign(batches):
        out = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])
        for ids, rows, low, high in _each_block(batches, length):
            at, d = nearest(rows, low, high, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(at, type=pa.int32()), pa.array(d)], schema=out)

    found = common.stored(blocks.mapInArrow(assign, "vec_id long, cluster int, distance long"), "zone-members")
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row per cluster
    total = sum(inertia.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(c, s, total, digests[c]) for c, s in inertia.items()],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(  # at most k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark, sf_dir) -> DataFrame:
    """op12: 16 clusters of floor(64 * x), three rounds."""
    return cluster(common.documents(spark, sf_dir, "embeddings"))
