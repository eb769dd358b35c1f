"""Structured Streaming: score orders as they reach the decision point.

The late-delivery classifier is meant to predict once the earlier of the ship
limit or the carrier hand-off has passed.  Here new order rows arrive as
parquet files; a stateless streaming query imputes, filters the outlier rules,
scales and scores each micro-batch with a model fitted on the training rows,
and appends predictions to a parquet sink.  No state, watermark or late-data
handling is implied by the analysis, so none is kept.

The model is an MLlib ``PipelineModel`` whose stages all work on streaming
frames: Imputer (fitted before the outlier rules, so its means include the
outliers) -> assembler -> StandardScaler (fitted on the cleaned training rows)
-> assembler -> classifier.
"""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.variables import DISTANCE_MAX_KM, SHIP_MISS_TRIM
from ..session import fresh_path


def _outlier_rules_on_imputed() -> F.Column:
    return ((F.col("shipping_limit_miss_amt__imp") >= SHIP_MISS_TRIM)
            & (F.col("distance_km__imp") < DISTANCE_MAX_KM))


def fit_scoring_model(train: DataFrame, predictors: list[str], unscaled: list[str], label: str) -> PipelineModel:
    imp_cols = [f"{c}__imp" for c in predictors]
    imputer = Imputer(strategy="mean", inputCols=predictors, outputCols=imp_cols).fit(
        train.select(*[F.col(c).cast("double").alias(c) for c in predictors], label))
    train_i = imputer.transform(train.select(*[F.col(c).cast("double").alias(c) for c in predictors],
                                             F.col(label).cast("double").alias("label")))
    train_o = train_i.where(_outlier_rules_on_imputed())  # outlier rules apply to imputed values
    scaled = [f"{c}__imp" for c in predictors if c not in unscaled]
    rest = Pipeline(stages=[
        VectorAssembler(inputCols=scaled, outputCol="_to_scale"),
        StandardScaler(inputCol="_to_scale", outputCol="_scaled", withMean=True, withStd=True),
        VectorAssembler(inputCols=["_scaled"] + [f"{c}__imp" for c in unscaled], outputCol="features"),
        NaiveBayes(modelType="gaussian", featuresCol="features", labelCol="label"),
    ]).fit(train_o)
    return PipelineModel(stages=[imputer, *rest.stages])


def score_stream(spark: SparkSession, source_dir: str, schema, model: PipelineModel, predictors: list[str],
                 key: str, label: str, sink_dir: str, checkpoint_dir: str, files_per_batch: int = 2) -> None:
    """Run the scoring stream over every file present (availableNow trigger)."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
              .parquet(source_dir))
    ready = stream.select(key, F.col(label).cast("double").alias("label"),
                          *[F.col(c).cast("double").alias(c) for c in predictors])
    imputed = model.stages[0].transform(ready)
    kept = imputed.where(_outlier_rules_on_imputed())
    scored = PipelineModel(stages=model.stages[1:]).transform(kept)
    out = scored.select(key, F.col("label").cast("int").alias(label),
                        F.col("prediction").cast("int").alias("predicted_late_flag"),
                        vector_to_array("probability")[1].alias("prob_late"))
    q = (out.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint_dir).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()


def stream_predictions(train: DataFrame, arrivals: DataFrame, predictors: list[str], unscaled: list[str],
                       key: str, label: str, n_files: int = 8) -> DataFrame:
    """Fit on ``train``; write ``arrivals`` as files into the shared folder;
    stream-score them; return the sink's rows."""
    spark = train.sparkSession
    model = fit_scoring_model(train, predictors, unscaled, label)
    run = uuid.uuid4().hex[:12]
    src, sink, ckpt = (fresh_path(spark, f"stream_{run}_{p}") for p in ("in", "out", "ckpt"))
    arrivals = arrivals.select(key, label, *predictors)
    arrivals.repartition(n_files, key).write.mode("overwrite").parquet(src)
    score_stream(spark, src, arrivals.schema, model, predictors, key, label, sink, ckpt)
    return spark.read.parquet(sink)
