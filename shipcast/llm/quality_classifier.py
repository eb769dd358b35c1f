"""Operator 3: quality scores from compression with class dictionaries.

Two zstandard dictionaries are trained, one on pieces of good and one on pieces
of bad labelled texts.  A text is cut into short blocks, each compressed with
either dictionary; the difference of the total sizes over the text's length says
which class it resembles, and a logistic curve, fitted on labelled texts that
the dictionaries have not seen, turns it into the probability of label 1.

Training reads a bounded sample of the labelled rows: the ``SAMPLE_DOCS`` rows of
each class that come first in a hash order, one text for each id, half of them for the dictionaries
(``SAMPLE_BLOCKS`` distinct blocks of a class), half for the curve.  Classes are weighted
back to their counts among all labelled rows.  Scoring uses every byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, ragged

SAMPLE_DOCS = 3000
SAMPLE_BLOCKS = 6000
BLOCK_BYTES = 512
DICTIONARY_BYTES = 65536
LEVEL = 3
SHRINK_BYTES = 256


@dataclass
class Model:
    """Dictionaries of the two classes and the curve; ``slope`` 0 where a class has no sample."""

    good: bytes
    bad: bytes
    slope: float
    intercept: float

    def compressors(self):
        import zstandard

        return [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d),
                                         write_content_size=False, write_checksum=False, write_dict_id=False)
                for d in (self.good, self.bad)]

    def scores(self, gaps: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * gaps + self.intercept, -30, 30)))


def blocks_of(text: bytes) -> list[bytes]:
    return [text[i:i + BLOCK_BYTES] for i in range(0, len(text), BLOCK_BYTES)]


def gap(text: bytes, compressors) -> float:
    """(bytes with the bad dictionary - bytes with the good one) over the text's length; 0 for an empty text.

    ``SHRINK_BYTES`` in the denominator draws very short texts towards 0.
    """
    good, bad = (sum(len(c.compress(b)) for b in blocks_of(text)) for c in compressors)
    return (bad - good) / (len(text) + SHRINK_BYTES)


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples' own bytes where they are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _curve(gaps: np.ndarray, good: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a weighted, lightly ridged logistic fit (Newton steps)."""
    scale = max(float(np.abs(gaps).mean()), 1e-6)
    x = np.stack([gaps / scale, np.ones(len(gaps))], axis=1)
    ridge, beta = np.diag([1e-2, 1e-6]) * weights.sum() / len(gaps), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = weights * p * (1 - p) + 1e-9
        step = np.linalg.solve(x.T @ (x * w[:, None]) + ridge, x.T @ (weights * (good - p)) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return max(float(beta[0]) / scale, 0.0), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, fold: int = 5) -> Model:
    """Train on ``labels(doc_id, quality)`` of ``docs(doc_id, text)`` outside the held-out fold.

    Rows whose crc32(doc_id as text) is divisible by ``fold`` are held out.
    Labels other than 0 and 1, and labels without a document, are ignored.  A label
    that is repeated counts once; an id labelled both 0 and 1 has no label.  If a
    class has no sample, the model gives every text the same score.
    """
    usable = (labels.where("quality in (0, 1) and doc_id is not null")
              .where(~common.crc32_held(F.col("doc_id"), fold, 0))
              .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
              .agg(F.min("quality").cast("int").alias("quality"), F.max("quality").cast("int").alias("other"))
              .where("quality = other").drop("other"))
    totals = {r[0]: r[1] for r in usable.groupBy("quality").count().collect()}
    order = F.xxhash64(F.lit("quality-sample"), "doc_id")
    picked = [usable.where(F.col("quality") == c).orderBy(order, "doc_id").limit(SAMPLE_DOCS) for c in (0, 1)]
    picked = picked[0].union(picked[1])
    # at most 2 * SAMPLE_DOCS ids and labels; of rows with one id, the text that comes first in a hash order
    text = F.min(F.struct(F.xxhash64("text").alias("place"), "text"))["text"]
    sample = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
              .join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(text.alias("text"))
              .withColumn("for_curve", F.pmod(F.xxhash64(F.lit("quality-half"), "doc_id"), F.lit(2)) == 1))
    sample = common.stored(sample, "quality-sample")

    def cut(batches):
        schema = pa.schema([("quality", pa.int32()), ("block", pa.binary())])
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                text = ragged.text_of(part.column("text"))
                found = [(q, b) for i, q in enumerate(part.column("quality").to_pylist()) for b in blocks_of(text.row(i))
                         if len(b) >= 32]
                yield common.batch_of(schema, [q for q, _ in found], [b for _, b in found])

    # distinct blocks: copies of one document must not fill a dictionary
    blocks = (sample.where("not for_curve").select("quality", "text").mapInArrow(cut, "quality int, block binary").distinct()
              .withColumn("place", F.xxhash64(F.base64("block"))))
    chosen = {c: [bytes(r[0]) for r in blocks.where(F.col("quality") == c).orderBy("place", "block")
                  .limit(SAMPLE_BLOCKS).select("block").collect()] for c in (0, 1)}
    n = sum(totals.values())
    constant = Model(b"", b"", 0.0, float(np.log((totals.get(1, 0) + 1) / (totals.get(0, 0) + 1))) if n else 0.0)
    if not (chosen[0] and chosen[1]):
        return constant
    model = Model(_dictionary(chosen[1]), _dictionary(chosen[0]), 1.0, 0.0)

    def measure(batches):
        schema = pa.schema([("quality", pa.int32()), ("gap", pa.float64())])
        pair = model.compressors()
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                text = ragged.text_of(part.column("text"))
                yield common.batch_of(schema, part.column("quality").to_pylist(),
                                      [gap(text.row(i), pair) for i in range(len(text))])

    rows = (sample.where("for_curve").select("quality", "text").mapInArrow(measure, "quality int, gap double")
            .orderBy("quality", "gap").collect())  # at most a row per id of the sample
    quality, gaps = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    if len(np.unique(quality)) < 2:
        return constant
    weights = np.array([totals[q] / (quality == q).sum() for q in quality])
    model.slope, model.intercept = _curve(gaps, quality.astype(float), weights * len(rows) / weights.sum())
    return model


def _scorer(model: Model):
    """Function giving the scores of a slice's texts."""
    pair = model.compressors() if model.good and model.bad else None

    def scores(part: pa.RecordBatch) -> np.ndarray:
        text = ragged.text_of(part.column("text"))
        gaps = np.array([gap(text.row(i), pair) if pair else 0.0 for i in range(len(text))])
        return model.scores(gaps)

    return scores


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (probability of label 1) of every row of ``docs(doc_id, text)``; null text is empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        scores = _scorer(model)
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(scores(part))],
                                                 schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, all columns unchanged."""

    def run(batches):
        scores = _scorer(model)
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                yield part.filter(pa.array(scores(part) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir) -> DataFrame:
    """op3: scores of all documents, labels of the fold crc32(doc_id) mod 5 = 0 unseen."""
    docs = common.documents(spark, sf_dir)
    model = fit(docs, common.documents(spark, sf_dir, "labels"))
    return quality_scores(docs, model).select(
        "doc_id", common.crc32_held(F.col("doc_id"), 5, 0).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))
