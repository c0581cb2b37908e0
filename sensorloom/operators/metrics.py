"""Evaluation of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import SENSOR

#: Bins of scores that are ordered apart from each other.
BINS = 1024


def confusion_matrix(df: DataFrame, truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Rows by true class; columns pred_0 and pred_1."""
    return df.groupBy(truth).agg(F.count_if(F.col(pred) == 0).alias("pred_0"), F.count_if(F.col(pred) == 1).alias("pred_1"))


def binary_metrics(df: DataFrame, by: tuple[str, ...] = (), truth: str = "y_true", score: str = "score", cut: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, log loss and area under the curve, per group.

    The area comes from ranks of distinct scores, counted before they are ordered.
    """
    y, hit = F.col(truth).cast("double"), (F.col(score) > cut).cast("double")
    p = F.greatest(F.least(F.col(score).cast("double"), F.lit(1 - 1e-7)), F.lit(1e-7))
    base = df.groupBy(*by).agg(
        F.avg((y == hit).cast("double")).alias("accuracy"),
        (F.sum(y * hit) / F.nullif(F.sum(hit), F.lit(0.0))).alias("precision"),
        (F.sum(y * hit) / F.nullif(F.sum(y), F.lit(0.0))).alias("recall"),
        (-F.avg(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"),
    )
    counts = df.groupBy(*by, F.col(score).cast("double").alias("__s")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    # scores are ordered within bins of equal width, and bins among each other: no task orders a whole group
    limits = counts.groupBy(*by).agg(F.min("__s").alias("__low"), F.max("__s").alias("__high"))
    counts = counts.join(limits, list(by)) if by else counts.crossJoin(F.broadcast(limits))
    bin_of = F.floor((F.col("__s") - F.col("__low")) / F.nullif(F.col("__high") - F.col("__low"), F.lit(0.0)) * BINS)
    counts = counts.withColumn("__bin", F.coalesce(bin_of, F.lit(0)))
    among = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = counts.groupBy(*by, "__bin").agg(F.sum("neg").alias("__neg")).withColumn("__under", F.coalesce(F.sum("__neg").over(among), F.lit(0.0))).drop("__neg")
    within = Window.partitionBy(*by, "__bin").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    lower = counts.join(bins, [*by, "__bin"]).withColumn("below", F.col("__under") + F.coalesce(F.sum("neg").over(within), F.lit(0.0)))
    area = lower.groupBy(*by).agg((F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("auc"))
    return base.join(area, list(by)) if by else base.crossJoin(area)


def mse(df: DataFrame, by: tuple[str, ...] = (), truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(truth) - F.col(pred), F.lit(2.0))).alias("mse"))


def positives(df: DataFrame, values: DataFrame, truth: str = "y_true", score: str = "score", cut: float = 0.5) -> DataFrame:
    """(sensor_id, idx, kind, value) of true and of predicted positives."""
    kinds = F.array_compact(F.array(F.when(F.col(truth) == 1, "true"), F.when(F.col(score) > cut, "predicted")))
    return df.select(SENSOR, "idx", F.explode(kinds).alias("kind")).join(values, [SENSOR, "idx"])
