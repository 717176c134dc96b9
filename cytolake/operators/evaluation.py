"""Scores of classifiers and summaries over folds."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytolake.functions.ordering import running_totals
from cytolake.runtime import cut

GRID = 100


def binarize(p: Column, threshold: float = 0.5) -> Column:
    return (p > F.lit(threshold)).cast("int")


def accuracy(predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return predictions.groupBy(*keys).agg(
        F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy")
    )


def balanced_accuracy(predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean recall over the classes present in the truth."""
    recall = predictions.groupBy(*keys, "label").agg(
        F.avg((F.col("label") == F.col("pred")).cast("double")).alias("recall")
    )
    return recall.groupBy(*keys).agg(F.avg("recall").alias("balanced_accuracy"))


def common_counts(scores: DataFrame) -> DataFrame:
    """Scores (fold, k, score) of the feature counts every fold has."""
    folds = scores.select("fold").distinct().count()
    per_k = scores.groupBy("k").agg(F.countDistinct("fold").alias("_has"))
    return scores.join(per_k.where(F.col("_has") == folds), "k", "left_semi")


def score_by_count(scores: DataFrame) -> DataFrame:
    """Mean, min, max and population std over folds per feature count; missing scores left out."""
    return scores.groupBy("k").agg(
        F.avg("score").alias("mean"),
        F.min("score").alias("min"),
        F.max("score").alias("max"),
        F.stddev_pop("score").alias("std"),
    )


def best_count(by_count: DataFrame) -> DataFrame:
    """The feature count with the best mean; of equal ones the larger."""
    return by_count.orderBy(F.col("mean").desc(), F.col("k").desc()).limit(1)


def consensus_ranking(rankings: DataFrame, k: int) -> DataFrame:
    """Features of the folds' first ``k`` ranks by how often they appear, then by how early.

    Rank r (from 1) is worth 10^(k - r + 1); the score is the log10 of the sum, taken relative to the
    best rank so that no power overflows.
    """
    used = rankings.where(F.col("rank") <= k)
    worth = F.lit(k + 1) - F.col("rank")
    tops = used.groupBy("feature").agg(F.max(worth).alias("_top"), F.count("*").alias("count"))
    return (
        used.join(tops, "feature")
        .groupBy("feature", "count", "_top")
        .agg(F.sum(F.pow(F.lit(10.0), worth - F.col("_top"))).alias("_sum"))
        .select("feature", "count", (F.col("_top") + F.log10("_sum")).alias("score"))
    )


def roc_points(scored: DataFrame, keys: Sequence[str] = ("fold",)) -> DataFrame:
    """ROC steps per fold: one row per distinct score, with the rates before and after it."""
    keys = list(keys)
    # read by the ranking more than once
    steps = cut(
        scored.groupBy(*keys, "score")
        .agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
        .withColumn("_down", -F.col("score"))
    )
    cumulated = running_totals(steps, keys, "_down", {"_tp": "pos", "_fp": "neg"})
    totals = steps.groupBy(*keys).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return cumulated.join(totals, keys).select(
        *keys,
        F.col("score").alias("threshold"),
        F.try_divide(F.col("_fp") - F.col("neg"), "_n").alias("fpr_before"),
        F.try_divide(F.col("_tp") - F.col("pos"), "_p").alias("tpr_before"),
        F.try_divide("_fp", "_n").alias("fpr"),
        F.try_divide("_tp", "_p").alias("tpr"),
    )


def roc_auc(points: DataFrame, keys: Sequence[str] = ("fold",)) -> DataFrame:
    strip = (F.col("fpr") - F.col("fpr_before")) * (F.col("tpr") + F.col("tpr_before")) / 2
    return points.groupBy(*keys).agg(F.sum(strip).alias("auc"))


def mean_roc(points: DataFrame, by_error: bool = False, n: int = 45, grid: int = GRID) -> DataFrame:
    """Mean curve over folds on an even grid of false-positive rates, with a clipped band.

    A rising step of a curve fills in the grid places it spans, so each fold yields every place once
    and no curve is joined to the grid. Ends are set to 0 and 1. The band is one std, or
    std / sqrt(n) with ``by_error``.
    """
    last = grid - 1
    lo = F.ceil(F.round(F.col("fpr_before") * last, 9))
    hi = F.ceil(F.round(F.col("fpr") * last, 9)) - 1
    spans = points.where("fpr > fpr_before").withColumn("_lo", lo).withColumn("_hi", hi).where("_lo <= _hi")
    at = F.col("i") / F.lit(float(last))
    slope = (F.col("tpr") - F.col("tpr_before")) / (F.col("fpr") - F.col("fpr_before"))
    inner = spans.select("*", F.explode(F.sequence("_lo", "_hi")).alias("i")).select(
        "fold",
        "i",
        F.when(F.col("i") == 0, F.lit(0.0)).otherwise(F.col("tpr_before") + slope * (at - F.col("fpr_before"))).alias("tpr"),
    )
    ends = points.select("fold").distinct().select("fold", F.lit(last).cast("bigint").alias("i"), F.lit(1.0).alias("tpr"))
    stats = inner.where(F.col("i") < last).unionByName(ends).groupBy("i").agg(
        F.avg("tpr").alias("mean_tpr"), F.stddev_pop("tpr").alias("_std")
    )
    half = F.col("_std") / F.lit(float(n) ** 0.5) if by_error else F.col("_std")
    return stats.select(
        (F.col("i") / F.lit(float(last))).alias("fpr"),
        "mean_tpr",
        F.greatest(F.col("mean_tpr") - half, F.lit(0.0)).alias("low"),
        F.least(F.col("mean_tpr") + half, F.lit(1.0)).alias("high"),
    )
