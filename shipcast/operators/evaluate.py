"""Model evaluation as DataFrame aggregates: confusion matrix, accuracy,
R^2 / RMSE, precision-recall and ROC curves, average precision, ROC AUC.

Curves first collapse the scored rows to one row per distinct score (a
partially aggregated ``groupBy``), then need running sums in descending score
order: range-partition the distinct scores, checkpoint (so the partition
assignment is fixed), total each partition, and add each partition's offset
from a table of per-partition totals (one row per partition).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def confusion_matrix(df: DataFrame, label: str, pred: str) -> DataFrame:
    """(actual, predicted, cnt); absent cells are absent."""
    return (df.groupBy(F.col(label).alias("actual_late_flag"), F.col(pred).alias("predicted_late_flag"))
            .agg(F.count(F.lit(1)).alias("cnt")))


def accuracy(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"),
                  F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def r2_rmse(df: DataFrame, label: str, pred: str) -> DataFrame:
    """n, R^2 = 1 - SSE/SST, MSE, RMSE of a regression prediction (one pass)."""
    y, p = F.col(label).cast("double"), F.col(pred).cast("double")
    base = df.where(y.isNotNull() & p.isNotNull())
    s = base.agg(F.count(F.lit(1)).alias("n"), F.sum((y - p) ** 2).alias("sse"),
                 F.var_pop(y).alias("_vy"))
    return s.select("n", (1 - F.try_divide(F.col("sse"), F.col("_vy") * F.col("n"))).alias("r2"),
                    (F.col("sse") / F.col("n")).alias("mse"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"))


def score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, tp, fp): positives / negatives per distinct score."""
    y = F.col(label).cast("long")
    return (df.where(F.col(score).isNotNull() & y.isNotNull())
            .groupBy(F.col(score).cast("double").alias("score"))
            .agg(F.sum(y).alias("tp"), F.sum(1 - y).alias("fp")))


def _running(counts: DataFrame) -> DataFrame:
    """Add cum_tp, cum_fp: sums over scores >= this score."""
    num_partitions = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = cut_lineage(counts.repartitionByRange(num_partitions, F.desc("score"))
                         .withColumn("_pid", F.spark_partition_id()))
    totals = parted.groupBy("_pid").agg(F.sum("tp").alias("_ttp"), F.sum("fp").alias("_tfp"))
    wp = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", F.coalesce(F.sum("_ttp").over(wp), F.lit(0)).alias("_otp"),
                            F.coalesce(F.sum("_tfp").over(wp), F.lit(0)).alias("_ofp"))
    w = (Window.partitionBy("_pid").orderBy(F.desc("score"))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (parted.join(F.broadcast(offsets), "_pid")  # one row per partition
            .select("score", "tp", "fp",
                    (F.sum("tp").over(w) + F.col("_otp")).alias("cum_tp"),
                    (F.sum("fp").over(w) + F.col("_ofp")).alias("cum_fp")))


def _with_totals(run: DataFrame) -> DataFrame:
    tot = run.agg(F.sum("tp").alias("P"), F.sum("fp").alias("N"))
    return run.crossJoin(F.broadcast(tot))  # one row


def pr_curve(df: DataFrame, label: str, score: str, stop_at_full_recall: bool = False) -> DataFrame:
    """Precision-recall points, one per distinct score threshold (score >= t),
    from the highest threshold down, plus the end point (precision 1, recall 0,
    threshold null).  ``stop_at_full_recall`` ends the curve at the first
    threshold that reaches full recall."""
    r = _with_totals(_running(score_counts(df, label, score)))
    if stop_at_full_recall:
        full = r.where(F.col("cum_tp") == F.col("P")).agg(F.max("score").alias("_t_full"))
        r = r.crossJoin(F.broadcast(full)).where(F.col("score") >= F.col("_t_full"))  # one row
    pts = (r.select(F.col("score").alias("threshold"),
                   (F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))).alias("precision"),
                   F.try_divide(F.col("cum_tp").cast("double"), F.col("P").cast("double")).alias("recall")))
    end = df.sparkSession.createDataFrame([(None, 1.0, 0.0)], "threshold double, precision double, recall double")
    return pts.unionByName(end)


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """AP = sum over thresholds of (R_n - R_(n-1)) * P_n; the recall step at a
    threshold is that score's positives / all positives."""
    r = _with_totals(_running(score_counts(df, label, score)))
    return r.agg(F.sum(F.col("tp") / F.col("P") * F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp")))
                 .alias("average_precision"))


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """ROC points (threshold, fpr, tpr), one per distinct score, plus (0, 0)."""
    r = _with_totals(_running(score_counts(df, label, score)))
    pts = r.select(F.col("score").alias("threshold"),
                   F.try_divide(F.col("cum_fp").cast("double"), F.col("N").cast("double")).alias("fpr"),
                   F.try_divide(F.col("cum_tp").cast("double"), F.col("P").cast("double")).alias("tpr"))
    start = df.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return start.unionByName(pts)


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve by the rank-sum rule (ties count one half):
    sum over scores of tp_s * (negatives scored lower + fp_s / 2) / (P * N).
    Needs no ordering: 'negatives lower' = N - negatives at or above."""
    r = _with_totals(_running(score_counts(df, label, score)))
    return r.agg(F.try_divide(F.sum(F.col("tp") * (F.col("N") - F.col("cum_fp") + F.col("fp") / 2.0)),
                              F.first(F.col("P") * F.col("N")).cast("double")).alias("roc_auc"))
