"""Operator 13: hard-negative mining with an inverted multi-index.

The vectors' halves have a codebook each, fitted on a bounded sample; a pair of
codewords is a cell, and every row is in one.  With the radius of a codeword (the
largest distance of a member's half from it) a cell's rows score at most
u_i + v_j against an anchor, where u_i = <half, codeword> + |half| * radius, and at
least the same with the radii subtracted.  A search for the first rows of a score
window takes the cells by a heap over the two sorted lists of half bounds, best
sum first.  It skips cells whose least score lies above the window and ends when
the next sum is below the window or below the last place of a full result: no row
in an unvisited cell can then enter it, so results are exact.

Cells lie together in blocks of rows; a cell with more rows than a block holds is
spread over several.  Searches go to blocks in two rounds: the first visits the
best cells, its results certify where the second one ends.  Searches and blocks
meet in tasks of bounded size.  Only the codebooks and one row for each cell (at
most ``codewords`` squared) pass through the driver.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, vectors

SCALE = 256
CODEWORDS = 32
BLOCK_ROWS = 4096
FIRST_ROWS = 2 * BLOCK_ROWS  # rows that a search visits in the first round, at least
TILE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # a negative's score in hundredths of the positive's


def codebook(points: np.ndarray, codewords: int, rounds: int = 8, seed: int = 13) -> np.ndarray:
    """Codewords of a bounded sample by Lloyd's rounds."""
    points = np.unique(points, axis=0)
    if len(points) <= codewords:
        return points
    words = points[np.random.default_rng(seed).choice(len(points), codewords, replace=False)]
    for _ in range(rounds):
        at = ((points[:, None, :] - words[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        sums = np.zeros_like(words)
        np.add.at(sums, at, points)
        n = np.bincount(at, minlength=len(words))[:, None]
        words = np.where(n > 0, sums / np.maximum(n, 1), words)
    return words


class MultiIndex:
    """Codebooks of the two halves, their radii, and the blocks of every cell."""

    def __init__(self, sample: np.ndarray, codewords: int):
        self.cut = sample.shape[1] // 2
        self.words = [codebook(sample[:, :self.cut], codewords), codebook(sample[:, self.cut:], codewords)]
        self.radii: list[np.ndarray] = []
        self.first: dict[int, tuple[int, int, int]] = {}  # cell -> first block, blocks, rows

    def halves(self, rows: np.ndarray):
        return rows[:, :self.cut], rows[:, self.cut:]

    def place(self, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Cell of each row, and its halves' distances from their codewords."""
        at, away = [], []
        for half, words in zip(self.halves(rows.astype(np.float64)), self.words):
            d = (half * half).sum(axis=1)[:, None] - 2 * half @ words.T + (words * words).sum(axis=1)[None, :]
            near = d.argmin(axis=1)
            at.append(near)
            away.append(np.sqrt(((half - words[near]) ** 2).sum(axis=1)))
        return at[0] * len(self.words[1]) + at[1], away

    def settle(self, cells: list, block_rows: int) -> None:
        """Take the radii from the facts of the cells (cell, n, away0, away1) and deal the cells to blocks."""
        wide = len(self.words[1])
        self.radii = [np.zeros(len(w)) for w in self.words]
        block, filled = 0, 0
        for cell, n, *away in sorted(cells):
            for half, i in enumerate(divmod(cell, wide)):
                # a little more than measured: sums of doubles in another order
                self.radii[half][i] = max(self.radii[half][i], away[half] * (1 + 1e-9) + 1e-6)
            blocks = -(-n // block_rows)
            if filled and filled + n > block_rows:
                block, filled = block + 1, 0
            self.first[cell] = (block, blocks, n)
            if blocks > 1:
                block, filled = block + blocks, 0
            else:
                filled += n

    def by_bound(self, anchor: np.ndarray):
        """(cell, most, least): cells by falling upper bound of the score, from a heap over the half bounds."""
        up, down, order = [], [], []
        for half, words, radii in zip(self.halves(anchor[None, :].astype(np.float64)), self.words, self.radii):
            score, slack = words @ half[0], np.sqrt((half[0] ** 2).sum()) * radii
            up.append(score + slack)
            down.append(score - slack)
            order.append(np.argsort(-up[-1], kind="stable"))
        (u, v), (p, q), wide = up, order, len(self.words[1])
        margin = 1e-6 * (1 + np.abs(u).max() + np.abs(v).max())
        heap = [(-(u[p[0]] + v[q[0]]), 0, 0)]
        while heap:
            bound, a, b = heapq.heappop(heap)
            i, j = int(p[a]), int(q[b])
            yield i * wide + j, -bound + margin, down[0][i] + down[1][j] - margin
            if b + 1 < len(q):
                heapq.heappush(heap, (-(u[i] + v[q[b + 1]]), a, b + 1))
            if b == 0 and a + 1 < len(p):
                heapq.heappush(heap, (-(u[p[a + 1]] + v[q[0]]), a + 1, 0))

    def blocks(self, anchor: np.ndarray, low, high, certain, first_rows: int, later: bool) -> list[int]:
        """Blocks of a search's first round, or of the later one, which ends at the certified score."""
        end = max(x for x in (low, certain, -np.inf) if x is not None)
        seen, rest, rows = set(), set(), 0
        for cell, most, least in self.by_bound(anchor):
            if most < (end if later else low if low is not None else -np.inf):
                break
            if cell not in self.first or (high is not None and least > high):
                continue
            block, n_blocks, n = self.first[cell]
            if rows < first_rows:
                seen.update(range(block, block + n_blocks))
                rows += n
            elif later:
                rest.update(range(block, block + n_blocks))
            else:
                break
        return sorted(rest - seen) if later else sorted(seen)


def _routed(searches: DataFrame, index: MultiIndex, first_rows: int, later: bool) -> DataFrame:
    """``searches`` at each block of the round."""
    columns = [c for c in searches.columns if c != "certain"]

    def run(batches):
        for batch in batches:
            anchors = vectors.matrix(batch.column("vec"))
            limits = [batch.column(c).to_pylist() for c in ("low", "high", "certain")]
            found = [index.blocks(a, *edge, first_rows, later) for a, *edge in zip(anchors, *limits)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(found, type=pa.list_(pa.int64()))],
                                             names=[*columns, "blocks"])

    kinds = dict(searches.dtypes)
    spelled = ", ".join(f"{c} {kinds[c]}" for c in columns)
    # written: the visits are counted for each block before they are dealt
    visits = common.stored(searches.mapInArrow(run, f"{spelled}, blocks array<bigint>"), "negatives-visits")
    return visits.select(*columns, F.explode("blocks").alias("block"))


def _first_of_block(k: int, same: bool):
    """Task function: the first k rows of a block in each search's window."""
    schema = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return schema.empty_table()
        base, ids, labels = vectors.matrix(rows.column("vec")), rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        anchors = vectors.matrix(asked.column("vec"))
        own, own_label = asked.column("anchor_id").to_numpy(), asked.column("label").to_numpy()
        ends = [np.array([d if x is None else x for x in asked.column(c).to_pylist()], dtype=np.int64)
                for c, d in (("low", -(1 << 62)), ("high", 1 << 62))]
        largest = float(np.abs(base).max(initial=0)) * float(np.abs(anchors).max(initial=0)) * base.shape[1]
        kind = np.float64 if largest < 2.0 ** 53 else np.int64  # sums of products are whole in a double below 2^53
        base, anchors = base.astype(kind), anchors.astype(kind)
        out = []
        for at in range(0, len(anchors), TILE):
            tile = slice(at, at + TILE)
            scores = anchors[tile] @ base.T
            fits = (labels[None, :] == own_label[tile, None]) == same
            fits &= (scores >= ends[0][tile, None]) & (scores <= ends[1][tile, None])
            if same:
                fits &= ids[None, :] != own[tile, None]
            if scores.shape[1] > k:
                low = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
                ranked = np.where(fits, scores, low)
                fits &= ranked >= np.partition(ranked, scores.shape[1] - k, axis=1)[:, [scores.shape[1] - k]]
            i, j = np.nonzero(fits)
            order = np.lexsort((ids[j], -scores[i, j], i))
            i, j = i[order], j[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            i, j = i[place < k], j[place < k]
            out.append((i + at, ids[j], scores[i, j].astype(np.int64)))
        i, found, score = (np.concatenate(x) for x in zip(*out))
        return pa.table([asked.column("anchor_id").combine_chunks().take(pa.array(i)),
                         asked.column("positive_id").combine_chunks().take(pa.array(i)), pa.array(found), pa.array(score)],
                        schema=schema)

    return run


def _first_in_window(rows: DataFrame, searches: DataFrame, index: MultiIndex, k: int, same: bool, first_rows: int) -> DataFrame:
    """anchor_id, positive_id, id, score, rank: the first ``k`` rows of each search's window."""
    schema = "anchor_id long, positive_id long, id long, score long"
    keys = ["anchor_id", "positive_id"]
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")

    def visited(asked: DataFrame, later: bool) -> DataFrame:
        return vectors.against_blocks(rows, _routed(asked, index, first_rows, later), ["block"], _first_of_block(k, same), schema)

    def first(df: DataFrame) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    begun = common.stored(first(visited(searches.withColumn("certain", F.lit(None).cast("long")), False)).drop("rank"), "negatives-first")
    full = begun.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    certified = (searches.join(full.withColumnRenamed("anchor_id", "a").withColumnRenamed("positive_id", "p"),
                               (F.col("anchor_id") == F.col("a")) & F.col("positive_id").eqNullSafe(F.col("p")), "left")
                 .withColumn("certain", F.when(F.col("n") == k, F.col("least"))).drop("a", "p", "n", "least"))
    return first(begun.union(visited(certified, True)))


def _whole(df: DataFrame, scale: int) -> DataFrame:
    """``df`` with floor(scale * x) of the components of ``vec``."""
    from .zone_clusters import whole_numbers

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("vec")
            numbers = whole_numbers(vectors.matrix(batch.column(at)), scale)
            if numbers.size and float(np.abs(numbers).max()) ** 2 * numbers.shape[1] * 100 >= 2.0 ** 63:
                raise OverflowError("scores would not fit a long")
            yield batch.set_column(at, "vec", vectors.lists(numbers, pa.int32()))

    return df.mapInArrow(run, "vec_id long, label long, vec array<int>")


def hard_negatives(df: DataFrame, anchor_modulus: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   scale: int = SCALE, codewords: int = CODEWORDS, block_rows: int = BLOCK_ROWS,
                   first_rows: int = FIRST_ROWS, vec_id: str = "vec_id", vector: str = "embedding",
                   label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows without an id, a label or a vector, with an empty one, or with a null or
    non-finite component, take no part.  Rows are told apart by their id: of rows with one id, the least
    vector (then label) stays.  Vectors of different length are not compared.
    Scores are whole numbers; a table whose scores would leave 64 bits is refused.
    """
    spark = df.sparkSession
    number = F.col(label).cast("long")
    kept = df.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & vectors.finite(vector) & (F.size(vector) > 0))
    kept = (kept.groupBy(F.col(vec_id).cast("long").alias("vec_id"))
            .agg(F.min(F.struct(F.col(vector).cast("array<double>").alias("vec"), number.alias("label"))).alias("r"))
            .select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("r.label") + 1) % 10).otherwise(F.col("r.label")).alias("label"),
                    "r.vec"))
    base = common.stored(kept, "negatives-rows")
    parts = []
    for dim, _ in vectors.lengths(base, "vec"):
        rows = _whole(base.where(F.size("vec") == dim), scale)
        index = MultiIndex(np.floor(vectors.sample(base.where(F.size("vec") == dim), "vec_id", "vec").reshape(-1, dim) * scale), codewords)

        def place(batches, index=index):
            for batch in batches:
                cell, away = index.place(vectors.matrix(batch.column("vec")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, type=pa.int64()), *map(pa.array, away)],
                                                 names=[*batch.schema.names, "cell", "away0", "away1"])

        placed = common.stored(rows.mapInArrow(
            place, "vec_id long, label long, vec array<int>, cell long, away0 double, away1 double"), "negatives-placed")
        facts = placed.groupBy("cell").agg(F.count(F.lit(1)), F.max("away0"), F.max("away1"))
        index.settle([tuple(r) for r in facts.collect()], block_rows)  # a row for each pair of codewords
        blocks = spark.createDataFrame([(c, b, n) for c, (b, n, _) in index.first.items()], "cell long, first long, n long")
        here = (placed.join(F.broadcast(blocks), "cell")  # at most codewords squared rows
                .select("vec_id", "label", "vec", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("n"))).alias("block")))
        none = F.lit(None).cast("long")
        anchors = placed.where(F.col("vec_id") % anchor_modulus == 0).select(F.col("vec_id").alias("anchor_id"), "label", "vec")
        first = _first_in_window(here, anchors.select(
            "anchor_id", none.alias("positive_id"), "label", "vec", none.alias("low"), none.alias("high")),
            index, positives, True, first_rows)
        pairs = common.stored(first.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")),
                              "negatives-positives")
        score = F.col("positive_score")
        # 100 * negative between 30 and 90 times the positive, in whole numbers
        low, high = F.expr(f"-((-{LOW} * positive_score - pmod(-{LOW} * positive_score, 100)) div 100)"), F.expr(
            f"({HIGH} * positive_score - pmod({HIGH} * positive_score, 100)) div 100")
        asked = pairs.join(anchors, "anchor_id").where(score >= 0).select(  # below 0 the window is empty
            "anchor_id", "positive_id", "label", "vec", low.alias("low"), high.alias("high"))
        found = _first_in_window(here, asked, index, negatives, False, first_rows)
        parts.append(found.join(pairs, ["anchor_id", "positive_id"]).select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score")))
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                         "positive_score long, negative_score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def query(spark, sf_dir) -> DataFrame:
    """op13: the first 10 negatives of each anchor and positive, anchors where 100 divides vec_id."""
    return hard_negatives(common.documents(spark, sf_dir, "embeddings"))
