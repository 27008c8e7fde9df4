"""Predictive scores as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def f1_macro(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Mean F1 over the labels in truth U prediction (one row ``f1``).

    One pass over the rows counts the (truth, prediction) pairs; tp, support and
    predicted counts of a label come from that table of classes squared rows."""
    pairs = confusion_counts(df, truth, pred)
    sides = F.array(F.struct(F.col("truth").alias("lbl"), F.col("n").alias("n_true"), F.lit(0).alias("n_pred")),
                    F.struct(F.col("prediction").alias("lbl"), F.lit(0).alias("n_true"), F.col("n").alias("n_pred")))
    tp = F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    j = (pairs.select(tp.alias("tp"), F.explode(sides).alias("s"))
         .groupBy("s.lbl").agg((F.sum("tp") / 2).alias("tp"), F.sum("s.n_true").alias("n_true"),
                               F.sum("s.n_pred").alias("n_pred"))
         .where(F.col("lbl").isNotNull()))
    denom = F.col("n_true") + F.col("n_pred")  # = 2tp + fp + fn
    f1 = F.when(denom > 0, F.lit(2.0) * F.col("tp") / denom).otherwise(F.lit(0.0))
    return j.agg(F.avg(f1).alias("f1"))


def confusion_counts(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(truth, prediction, n): one group-by."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("prediction")) \
        .agg(F.count(F.lit(1)).alias("n"))


def r2(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """``1 - SSres / SStot`` in one pass (``var_pop`` updates mean and squares together)."""
    res = F.col(truth) - F.col(pred)
    ss = df.agg(F.sum(res * res).alias("res"),
                (F.var_pop(truth) * F.count(F.col(truth))).alias("tot"))
    return ss.select(F.when(F.col("tot") > 0, F.lit(1.0) - F.col("res") / F.col("tot"))
                     .otherwise(F.lit(0.0)).alias("r2"))


def missing_classes(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Classes of ``test`` that never occur in ``train`` (left-anti join);
    one row: number of such classes and the guard flag (1 = scores are zeroed)."""
    miss = test.select(label).distinct().join(train.select(label).distinct(), on=label, how="left_anti")
    return miss.agg(F.count(F.lit(1)).cast("long").alias("n_missing_classes")).select(
        "n_missing_classes", (F.col("n_missing_classes") > 0).cast("long").alias("guard"))
