"""Evaluation: accuracy, error, MSE, confusion counts, AUC, importances.

All metrics are single aggregates (partial + final), except AUC, which needs
ranks: it is computed from per-score class counts and a distributed running
sum (``ranking.running_sums``), never a window over the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orchard.operators.ranking import running_sums


def accuracy(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    hit = (F.col(label) == F.col(prediction)).cast("double")
    return pred.select(F.avg(hit).alias("accuracy"))


def test_error(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    miss = (F.col(label) != F.col(prediction)).cast("double")
    return pred.select(F.avg(miss).alias("test_error"))


def misclassified(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return pred.where(F.col(label) != F.col(prediction))


def mse(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    err = F.pow(F.col(label).cast("double") - F.col(prediction).cast("double"), 2)
    return pred.select(F.avg(err).alias("mse"))


def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """TN, FP, FN, TP as one row (binary 0/1)."""
    y, p = F.col(label), F.col(prediction)

    def cnt(cond):
        return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")
    return pred.select(cnt((y == 0) & (p == 0)).alias("tn"), cnt((y == 0) & (p == 1)).alias("fp"),
                       cnt((y == 1) & (p == 0)).alias("fn"), cnt((y == 1) & (p == 1)).alias("tp"))


def auc(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under ROC = P(score of a positive > score of a negative) + half the ties.

    Per distinct score: positives and negatives (an aggregate), then the
    number of negatives scored lower via a distributed running sum.
    """
    per_score = pred.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.sum(F.when(F.col(label) == 1, 1.0).otherwise(0.0)).alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0.0).otherwise(1.0)).alias("neg"))
    cum = running_sums(per_score, ["s"], ["neg"], carry=["pos"])
    num = cum.select(F.sum(F.col("pos") * (F.col("neg_cum") - F.col("neg") * 0.5)).alias("u"),
                     F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    # NULL (not an ANSI error) when one class is absent
    return num.select(F.try_divide(F.col("u"), F.col("p") * F.col("n")).alias("auc"))


def feature_importance(spark: SparkSession, importances) -> DataFrame:
    """Rows (feature, importance) sorted by importance, from a model vector.

    The vector has one value per feature column, so its size is the schema
    width, not the data size.
    """
    rows = [(int(i), float(v)) for i, v in enumerate(importances.toArray())]
    schema = T.StructType([T.StructField("feature", T.IntegerType()),
                           T.StructField("importance", T.DoubleType())])
    return spark.createDataFrame(rows, schema).orderBy(F.desc("importance"), "feature")
