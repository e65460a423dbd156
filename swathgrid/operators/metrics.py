"""Evaluation metrics as aggregates over prediction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_counts(preds: DataFrame, n_classes: int, keys: list[str] = ()) -> DataFrame:
    """tp, fp, fn per class, including classes that never occur.

    Rows first shrink to the confusion matrix (n_classes squared at most), so class labels may be
    as lopsided as they like.
    """
    confusion = preds.groupBy(*keys, "target", "pred").agg(F.count(F.lit(1)).alias("n"))
    per_class = confusion.withColumn(
        "class", F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1)))
    )
    is_t, is_p = F.col("target") == F.col("class"), F.col("pred") == F.col("class")

    def total(cond):
        return F.sum(F.when(cond, F.col("n")).otherwise(0))

    return per_class.groupBy(*keys, "class").agg(
        total(is_t & is_p).alias("tp"),
        total(is_p & ~is_t).alias("fp"),
        total(is_t & ~is_p).alias("fn"),
        F.sum("n").alias("total"),
    )


def per_class(preds: DataFrame, n_classes: int, keys: list[str] = ()) -> DataFrame:
    """Precision, recall, F1 and overlap per class; empty denominators count as 1."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = class_counts(preds, n_classes, keys)
    out = out.withColumn("precision", tp / F.greatest(tp + fp, F.lit(1)))
    out = out.withColumn("recall", tp / F.greatest(tp + fn, F.lit(1)))
    pr = F.col("precision") + F.col("recall")
    out = out.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(pr, F.lit(1e-8)))
    return out.withColumn("iou", tp / F.greatest(tp + fp + fn, F.lit(1)))


def classification(preds: DataFrame, n_classes: int, keys: list[str] = ()) -> DataFrame:
    """Accuracy, macro F1 over all classes, and macro F1 over classes that occur."""
    rows = per_class(preds, n_classes, keys)
    present = F.col("tp") + F.col("fn") + F.col("fp") > 0
    return rows.groupBy(*keys).agg(
        (F.sum("tp") / F.greatest(F.max("total"), F.lit(1))).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        F.avg(F.when(present, F.col("f1"))).alias("present_macro_f1"),
        F.max("total").alias("n"),
    )


def segmentation(preds: DataFrame, n_classes: int = 2, keys: list[str] = ()) -> DataFrame:
    return per_class(preds, n_classes, keys).groupBy(*keys).agg(
        F.avg("iou").alias("mean_iou"), F.avg("f1").alias("mean_f1")
    )


def regression(preds: DataFrame, keys: list[str] = ()) -> DataFrame:
    """mse, rmse, R2 and Pearson correlation (0 where degenerate)."""
    t, p = F.col("target").cast("double"), F.col("pred").cast("double")
    a = preds.groupBy(*keys).agg(
        F.avg((p - t) * (p - t)).alias("mse"),
        F.sum((p - t) * (p - t)).alias("ss_res"),
        (F.var_pop(t) * F.count(t)).alias("ss_tot"),
        F.stddev_pop(t).alias("sd_t"),
        F.stddev_pop(p).alias("sd_p"),
        F.covar_pop(t, p).alias("cov"),
        F.count(t).alias("n"),
    )
    pearson = F.when(
        (F.col("n") > 1) & (F.col("sd_t") > 0) & (F.col("sd_p") > 0),
        F.col("cov") / (F.col("sd_t") * F.col("sd_p")),
    ).otherwise(0.0)
    return a.select(
        *keys,
        "mse",
        F.sqrt("mse").alias("rmse"),
        (1 - F.col("ss_res") / F.greatest(F.col("ss_tot"), F.lit(1e-8))).alias("r2"),
        pearson.alias("pearson"),
        "n",
    )


def ordinal_error(preds: DataFrame, keys: list[str] = ()) -> DataFrame:
    return preds.groupBy(*keys).agg(F.avg(F.abs(F.col("pred") - F.col("target"))).alias("mae"))


def metric_means(log: DataFrame, keys: list[str] = ("metric",)) -> DataFrame:
    """Mean of the per-batch values of each metric (not weighted by batch size)."""
    return log.groupBy(*keys).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n_batches"))


def best_epoch(log: DataFrame, metric: str, larger_is_better: bool, keys: list[str] = ()) -> DataFrame:
    """Epoch with the best value, ties to the earliest."""
    rows = log.where(F.col("metric") == metric)
    goal = F.max("value") if larger_is_better else F.min("value")
    first = rows.groupBy(*keys, "value").agg(F.min("epoch").alias("epoch"))
    pick = F.max_by if larger_is_better else F.min_by
    return first.groupBy(*keys).agg(pick("epoch", "value").alias("epoch"), goal.alias("value"))
