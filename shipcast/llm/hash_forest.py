"""Operator 11: approximate nearest neighbours by cosine with a hash-prefix forest.

A vector has a string of 63 bits in each of ``trees`` trees; a bit is the side of
a random hyperplane through the median of a bounded sample, so that a dense group
of vectors is cut by planes about as often as it has rows.  A tree is the array of
strings in sorted order: the vectors that agree with a query on its first x bits
are one run of it.  A search descends to its longest matches and ascends all trees
together, one bit at a time, until the runs of length-x prefixes hold the wanted
number of candidates; the candidates are compared exactly in double precision.

At scale a tree's array is kept in blocks: cells of equal first bits, whose number
grows with the table, and a cell with more rows than a block holds (a hot prefix)
is sliced by a hash.  Runs are counted block by block and added up for each query,
so all levels' counts are exact whatever the slicing.  Equal vectors are one entry
with its smallest ids: a search of k neighbours can meet no more than k + 1 of them.

The number of candidates comes from the data: the true neighbours of a bounded
sample of queries, found by comparing them with every row, tell how far searches
must ascend to meet the wanted share of neighbours.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, vectors

BITS = 63
TREES = 24
BLOCK_ROWS = 8192
SAMPLE_QUERIES = 256
RECALL = 0.96
K = 5


class Forest:
    """Hyperplanes of one vector length: drawn from a seed, cut at the medians of the sample."""

    def __init__(self, sample: np.ndarray, dim: int, trees: int, seed: int = 11):
        self.dim, self.trees, self.seed = dim, trees, seed
        self.cuts = np.array([_cut(c) for c in np.sort(_unit(sample) @ self.planes().T, axis=0).T])

    def planes(self) -> np.ndarray:
        return np.random.default_rng([self.seed, self.dim]).standard_normal((self.trees * BITS, self.dim))

    def hashes(self, rows: np.ndarray, planes: np.ndarray | None = None) -> np.ndarray:
        """(rows, trees) strings as numbers: their order is that of the strings."""
        bits = np.zeros((len(rows), self.trees, BITS + 1), dtype=bool)
        if len(rows):
            planes = self.planes() if planes is None else planes
            bits[:, :, 1:] = (_unit(rows) @ planes.T > self.cuts).reshape(len(rows), self.trees, BITS)
        return np.packbits(bits, axis=2).view(">u8").reshape(len(rows), self.trees).astype(np.int64)


def _cut(values: np.ndarray, gap: float = 1e-9) -> float:
    """A value near the median of the sorted ``values``, between two that differ by more than ``gap``:
    a vector's bit must not hang on how a product was rounded."""
    steps = np.flatnonzero(np.diff(values) > gap)
    if not len(steps):
        return values[-1] + 1.0
    at = steps[np.abs(steps + 1 - len(values) / 2).argmin()]
    return (values[at] + values[at + 1]) / 2


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # no over- or underflow in the norm
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _hashed(df: DataFrame, forest: Forest) -> DataFrame:
    """``df`` with the strings of its column ``vec``, a row per tree: tree, hash.  Hashed once: written as a list for each row."""
    def run(batches):
        planes = forest.planes()
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                found = vectors.lists(forest.hashes(vectors.matrix(part.column("vec")), planes), pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, "hashes"])

    spelled = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    table = common.stored(df.mapInArrow(run, f"{spelled}, hashes array<bigint>"), "forest-strings")
    return table.select(*df.columns, F.posexplode("hashes").alias("tree", "hash"))


def _shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of strings."""
    differ = a ^ b
    upper, lower = differ >> 32, differ & 0xFFFFFFFF  # each is whole in a double
    length = np.where(upper > 0, 32 + np.frexp(upper.astype(np.float64))[1], np.frexp(lower.astype(np.float64))[1])
    return BITS - length


def _scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines, the same for a pair wherever it is compared."""
    return (_unit(rows) * _unit(query[None, :])).sum(axis=1)


def _best(near: np.ndarray, rows: np.ndarray, firsts: np.ndarray, query: np.ndarray, k: int):
    """Places and scores of the k nearest rows, ties to the smaller id; ``near`` are rough scores."""
    if len(near) > k:
        picks = np.flatnonzero(near >= np.partition(near, len(near) - k)[len(near) - k] - 1e-9)
    else:
        picks = np.arange(len(near))
    exact = _scores(rows[picks], query) if len(picks) else np.zeros(0)
    order = np.lexsort((firsts[picks], -exact))[:k]
    return picks[order], exact[order]


def _counter(depth: int):
    """Task function: entries of a block that share x bits with a query, for each x from ``depth`` on."""
    schema = pa.schema([("sid", pa.int64()), ("counts", pa.list_(pa.int64()))])

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        strings = np.sort(rows.column("hash").to_numpy())
        own = asked.column("hash").to_numpy()
        counts = np.zeros((len(own), BITS + 1), dtype=np.int64)
        for x in range(depth, BITS + 1):
            low = (own >> (BITS - x)) << (BITS - x)
            high = low + ((1 << (BITS - x)) - 1)
            counts[:, x] = np.searchsorted(strings, high, side="right") - np.searchsorted(strings, low)
        return pa.table([asked.column("sid"), vectors.lists(counts, pa.int64())], schema=schema)

    return run


def _scorer(k: int, depth: int):
    """Task function: the k nearest entries of a block among those that share a query's level of bits."""
    schema = pa.schema([("sid", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        strings = rows.column("hash").to_numpy()
        order = np.argsort(strings, kind="stable")
        strings = strings[order]
        ids = rows.column("ids").combine_chunks().take(pa.array(order))
        firsts = ids.flatten().to_numpy(zero_copy_only=False)[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()] if len(ids) else np.zeros(0)
        whole = vectors.matrix(rows.column("vec"))[order]
        units = _unit(whole) if len(whole) else whole
        sids, places, scores = [], [], []
        queries = vectors.matrix(asked.column("vec"))
        for sid, own, level, query in zip(asked.column("sid").to_pylist(), asked.column("hash").to_pylist(),
                                          asked.column("level").to_pylist(), queries):
            low = (own >> (BITS - level)) << (BITS - level)
            start = np.searchsorted(strings, low)
            stop = np.searchsorted(strings, low + ((1 << (BITS - level)) - 1), side="right")
            if start < stop:
                at, exact = _best(units[start:stop] @ _unit(query[None, :])[0], whole[start:stop], firsts[start:stop], query, k)
                sids.append(np.full(len(at), sid))
                places.append(at + start)
                scores.append(exact)
        if not sids:
            return schema.empty_table()
        return pa.table([pa.array(np.concatenate(sids)), ids.take(pa.array(np.concatenate(places))),
                         pa.array(np.concatenate(scores))], schema=schema)

    return run


def _true_neighbours(nodes: DataFrame, asked: list, k: int) -> list:
    """(sid, vec) of the k nearest entries of each of a bounded number of queries, by comparing all."""
    sids = [r["sid"] for r in asked]
    queries = np.array([r["vec"] for r in asked], dtype=np.float64)

    def run(batches):
        units = _unit(queries)
        for batch in batches:
            rows = vectors.matrix(batch.column("vec"))
            firsts = np.array([i[0] for i in batch.column("ids").to_pylist()])
            for at in range(0, len(rows), 4096):
                part = rows[at:at + 4096]
                near = units @ _unit(part).T
                for i, sid in enumerate(sids):
                    places, exact = _best(near[i], part, firsts[at:at + 4096], queries[i], k)
                    yield pa.RecordBatch.from_pydict({
                        "sid": [sid] * len(places), "first": firsts[at:at + 4096][places], "score": exact,
                        "vec": part[places].tolist()}, schema=schema)

    schema = pa.schema([("sid", pa.int64()), ("first", pa.int64()), ("score", pa.float64()), ("vec", pa.list_(pa.float64()))])
    found = nodes.mapInArrow(run, "sid long, first long, score double, vec array<double>")
    place = F.row_number().over(Window.partitionBy("sid").orderBy(F.desc("score"), "first"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("sid", "vec").collect()


class _Search:
    """One vector length: entries ``nodes(ids, vec)`` and queries ``asked(sid, vec)``, both stored."""

    def __init__(self, nodes: DataFrame, asked: DataFrame, forest: Forest, n: int, block_rows: int):
        self.nodes, self.asked, self.forest = nodes, asked, forest
        self.depth = max(0, min(BITS, (max(n, 1) // block_rows).bit_length() - 1))
        shift = BITS - self.depth
        cell = F.shiftright("hash", shift).alias("cell")
        self.rows = _hashed(nodes, forest).select("*", cell)
        self.queries = _hashed(asked, forest).select("*", cell)
        sizes = self.rows.groupBy("tree", "cell").agg(F.count(F.lit(1)).alias("n"))
        self.cells = common.stored(
            sizes.withColumn("slices", F.ceil(F.col("n") / (2 * block_rows)).cast("int")), "forest-cells")

    def dealt(self, *columns: str) -> DataFrame:
        """Entries in their blocks."""
        place = F.pmod(F.xxhash64(F.col("ids")[0]), F.col("slices")).cast("int").alias("slice")
        return (self.rows.select("tree", "cell", "hash", "ids", *columns).join(self.cells, ["tree", "cell"])
                .select("tree", "cell", place, "hash", "ids", *columns))

    def everywhere(self, queries: DataFrame) -> DataFrame:
        """Queries, which name a tree and a cell, at each block of it."""
        return (queries.join(self.cells.drop("n"), ["tree", "cell"])
                .withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices"))

    def level_counts(self) -> DataFrame:
        """sid, counts: candidates in all trees for each level from ``depth`` on (0 before)."""
        at_blocks = vectors.against_blocks(
            self.dealt().drop("ids"), self.everywhere(self.queries.select("sid", "tree", "cell", "hash")),
            ["tree", "cell", "slice"], _counter(self.depth), "sid long, counts array<bigint>")
        sums = at_blocks.groupBy("sid").agg(*[F.sum(F.col("counts")[x]).alias(f"c{x}") for x in range(BITS + 1)])
        return sums.select("sid", F.array(*[f"c{x}" for x in range(BITS + 1)]).alias("counts"))

    def coarse_counts(self, sids: DataFrame) -> DataFrame:
        """sid, level, n for the levels above the cells, from the sizes of the cells."""
        level = F.explode(F.sequence(F.lit(0), F.lit(self.depth - 1))).alias("level")
        up = F.expr(f"shiftright(cell, cast({self.depth} - level as int))").alias("prefix")
        sizes = (self.cells.select("tree", "cell", "n", level).select("tree", "level", up, "n")
                 .groupBy("tree", "level", "prefix").agg(F.sum("n").alias("n")))
        wanted = self.queries.join(sids, "sid", "left_semi").select("sid", "tree", "cell", level).select("sid", "tree", "level", up)
        return wanted.join(sizes, ["tree", "level", "prefix"]).groupBy("sid", "level").agg(F.sum("n").alias("n"))

    def candidates_for(self, counts: DataFrame, k: int, recall: float, limit: int) -> int:
        """Candidates a search must hold so that the sampled queries meet ``recall`` of their neighbours."""
        asked = self.asked.orderBy(F.xxhash64("sid"), "sid").limit(limit).collect()
        spark = self.asked.sparkSession
        sids = F.broadcast(spark.createDataFrame([(r["sid"],) for r in asked], "sid long"))  # at most ``limit`` rows
        have = {r["sid"]: np.array(r["counts"]) for r in counts.join(sids, "sid", "left_semi").collect()}
        if self.depth:
            for r in self.coarse_counts(sids).collect():
                have[r["sid"]][r["level"]] = r["n"]
        own = {r["sid"]: self.forest.hashes(np.array([r["vec"]]))[0] for r in asked}
        needed = []
        for r in _true_neighbours(self.nodes, asked, k):
            met = int(_shared_bits(own[r["sid"]], self.forest.hashes(np.array([r["vec"]]))[0]).max())
            if met < BITS:  # the query's own entry is met in any case
                needed.append(int(have[r["sid"]][met + 1]) + 1)
        needed.sort()
        return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] if needed else 1

    def levels(self, counts: DataFrame, candidates: int) -> DataFrame:
        """sid, level: the longest prefix whose runs hold ``candidates`` in all trees together."""
        enough = F.transform("counts", lambda c, x: F.when(c >= candidates, x))
        at = counts.select("sid", F.array_max(enough).alias("level"))
        if not self.depth:
            return at.select("sid", F.coalesce("level", F.lit(0)).alias("level"))
        higher = self.coarse_counts(at.where("level IS NULL").select("sid"))
        reached = higher.where(F.col("n") >= candidates).groupBy("sid").agg(F.max("level").alias("up"))
        return at.join(reached, "sid", "left").select("sid", F.coalesce("level", "up", F.lit(0)).alias("level"))

    def nearest(self, levels: DataFrame, k: int) -> DataFrame:
        """sid, ids, score: the k nearest entries of each block that a search's runs reach."""
        d = self.depth
        leveled = self.queries.join(levels, "sid")
        first = F.expr(f"shiftleft(shiftright(cell, cast({d} - level as int)), cast({d} - level as int))")
        last = F.expr(f"shiftleft(shiftright(cell, cast({d} - level as int)) + 1, cast({d} - level as int)) - 1")
        placed = (leveled.withColumn("cell", F.explode(F.when(F.col("level") >= d, F.array("cell"))
                                                       .otherwise(F.sequence(first, last)))))
        return vectors.against_blocks(
            self.dealt("vec"), self.everywhere(placed), ["tree", "cell", "slice"], _scorer(k, d),
            "sid long, ids array<bigint>, score double")


def _one_each(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id, vec of the rows that take part, one for each id."""
    v = F.col(vector)
    kept = df.where(F.col(vec_id).isNotNull() & vectors.finite(vector) & F.exists(v, lambda x: x != 0))
    return kept.groupBy(F.col(vec_id).cast("long").alias("vec_id")).agg(F.min(vector).alias("vec"))


def nearest_neighbours(df: DataFrame, query_modulus: int = 50, k: int = K, trees: int = TREES,
                       candidates: int | None = None, recall: float = RECALL, block_rows: int = BLOCK_ROWS,
                       sample_queries: int = SAMPLE_QUERIES, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row whose id ``query_modulus`` divides.

    Rows without an id and vectors that are null, empty, zero or hold null or
    non-finite components take no part.  Rows are told apart by their id: of rows
    with one id, the least vector stays.  Vectors of different length are not
    compared.  Ties go to the smaller id.  Fewer candidates give fewer rows.
    ``candidates``: entries that a search gathers at least; by default as many as
    ``sample_queries`` queries need to meet ``recall`` of their true neighbours.
    """
    spark = df.sparkSession
    base = common.stored(_one_each(df, vec_id, vector), "forest-vectors")
    keyed = base.withColumn("key", F.xxhash64("vec"))
    place = F.row_number().over(Window.partitionBy("key", "vec").orderBy("vec_id"))
    nodes = common.stored(
        keyed.withColumn("place", place).where(F.col("place") <= k + 1)
        .groupBy("key", "vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("ids", "vec"), "forest-entries")
    rows = keyed.where(F.col("vec_id") % query_modulus == 0)
    heads = rows.groupBy("key", "vec").agg(F.min("vec_id").alias("sid"))
    heads = common.stored(heads, "forest-heads")
    parts = []
    for dim, n in vectors.lengths(nodes, "vec"):
        own = nodes.where(F.size("vec") == dim)
        asked = heads.where(F.size("vec") == dim).select("sid", "vec")
        if asked.isEmpty():
            continue
        forest = Forest(vectors.sample(own.withColumn("id", F.col("ids")[0]), "id", "vec"), dim, trees)
        search = _Search(own, asked, forest, n, block_rows)
        counts = common.stored(search.level_counts(), "forest-counts")
        wanted = candidates or search.candidates_for(counts, k + 1, recall, sample_queries)
        levels = common.stored(search.levels(counts, wanted), "forest-levels")
        parts.append(search.nearest(levels, k + 1))
    schema = "query_id long, rank int, vec_id long, score double"
    if not parts:
        return spark.createDataFrame([], schema)
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    each = (found.select("sid", F.explode("ids").alias("vec_id"), "score")
            .groupBy("sid", "vec_id").agg(F.max("score").alias("score")))
    order = Window.partitionBy("sid").orderBy(F.desc("score"), "vec_id")
    first = common.stored(each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
                          .groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near")),
                          "forest-found")
    mine = (rows.join(heads, ["key", "vec"]).select(F.col("vec_id").alias("query_id"), "sid").join(first, "sid")
            .withColumn("near", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)))
    return (mine.select("query_id", F.posexplode("near").alias("at", "x"))
            .select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score"))


def query(spark, sf_dir) -> DataFrame:
    """op11: the 5 nearest by cosine of every row whose vec_id 50 divides, among all rows."""
    return nearest_neighbours(common.documents(spark, sf_dir, "embeddings"))
